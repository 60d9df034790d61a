"""Near-equal bodies against all earlier distinct ones."""

from __future__ import annotations

from difflib import SequenceMatcher


def near(a, b):
    if not a or not b or a == b:
        return bool(a and a == b)
    x, y = sorted((a, b), key=len)
    if len(x) < 120:
        return False
    return x in y and len(y) - len(x) <= max(32, int(len(x) * 0.05)) or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.98


def test_first_match_of_all_earlier_turns(spark):
    from tessera.functions.similar import first_matches

    body = " ".join(f"word{k}" for k in range(40))
    other = " ".join(f"reply{k}" for k in range(40))
    short = "a sentence of fewer than one hundred and twenty characters, which is never near another that differs in one letter"
    texts = [body, other, body, None, "", short, short + "s", body.replace("word7", "wird7"), other + " more", "", body + " and some words more", body + " and some words more, and yet some others", short]
    rows = [(1, k, t) for k, t in enumerate(texts)] + [(2, 0, body)]
    want, seen = {(2, 0): None}, []
    for _, k, t in rows[:-1]:
        want[1, k] = next((m for m, s in seen if near(s, t)), None)
        if want[1, k] is None:
            seen.append((k, t))
    got = first_matches(spark.createDataFrame(rows, "conv_id bigint, turn int, text string")).collect()
    assert {(r.conv_id, r.turn): r.first_match for r in got} == want and len(got) == len(rows)
    assert all(r.near_equal == (r.first_match is not None) for r in got)
    assert want[1, 2] == 0 and want[1, 6] is None and want[1, 11] is None
