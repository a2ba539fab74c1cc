"""Valid values beside text that a greedy match would take in."""

import re

from brindle.llm.pii import pseudonymized

#: text, values that must go, how many
CASES = [
    ("card 4111 1111 1111 1111 12/25 end", ["4111 1111 1111 1111"], 1),
    ("card 4111111111111111 123", ["4111111111111111"], 1),
    ("no 12 4111 1111 1111 1111 x", ["4111 1111 1111 1111"], 1),
    ("4111 1111 1111 1111 4929 3483 8514 6306", ["4111 1111 1111 1111", "4929 3483 8514 6306"], 2),
    ("pay BE68 5390 0754 7034 BIC GKCCBEBB", ["BE68 5390 0754 7034"], 1),
    ("AB12 4111 1111 1111 1111", ["4111 1111 1111 1111"], 1),
    ("BE68 5390 0754 7034 4111 1111 1111 1111", ["BE68 5390 0754 7034", "4111 1111 1111 1111"], 2),
    ("call +1 (743) 555-3824 1984 1985 1986", ["555-3824"], 1),
    ("call (743) 555-3824 now", ["555-3824"], 1),
    ("call 743-555-3824 now", ["555-3824"], 1),
    ("password: correcthorsebattery", ["correcthorsebattery"], 1),
    ("to de89 3704 0044 0532 0130 00 then", ["3704 0044"], 1),
    ("on 1984/02/29, 29-02-1984", ["1984/02/29", "29-02-1984"], 2),
    ("Authorization: Bearer abcdef0123456789xyz end", ["abcdef0123456789xyz"], 1),
    ("ghp_abcdefghij0123456789klmn", ["abcdefghij0123456789klmn"], 1),
    ("call 07911 123456 now", ["911 123456"], 1),
    ("on 12/25/2026 and 25/12/2026", ["12/25/2026", "25/12/2026"], 2),
]
KEPT = ["13/25/2026", "card 4111 1111 1111 1112", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "BE68 5390 0754 7035", "id 9807915762804490", "a: b = c", "7435553824", "release v1.2.3.4", "1984/02/30", "bearer responsibilities", "de89 3704 0044 0532 0130 02"]


def test_values(spark):
    texts = [c[0] for c in CASES] + KEPT
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r["__text"], r["__n"]) for r in pseudonymized(df).orderBy("__row.doc_id").collect()]
    form = lambda x: re.sub("[a-z]", "a", re.sub("[0-9]", "0", x))
    for (text, values, n), (new, found) in zip(CASES, got, strict=False):
        assert found == n and form(new) == form(text) and not any(v in new for v in values), (text, new, found)
    assert got[len(CASES) :] == [(x, 0) for x in KEPT]


def test_forms_stay_valid_and_spellings_linked(spark):
    rows = [f"{a:03d}-{b:02d}-{c:04d}" for a, b, c in [(k % 665 + 1, k % 99 + 1, k % 9999 + 1) for k in range(1500)]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    new = [r["__text"] for r in pseudonymized(df, "a key").collect()]
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in new) and len(set(new)) == len(set(rows))
    phones = ["+49 30 1234567", "+49-30-1234567", "+49301234567", "+1 (743) 555-3824", "+1 743 555 3824"]
    df = spark.createDataFrame(list(enumerate(phones)), "doc_id long, text string")
    digits = lambda key: [re.sub(r"\D", "", r["__text"]) for r in pseudonymized(df, key).orderBy("__row.doc_id").collect()]
    one, two = digits("a key"), digits("another")
    assert len(set(one[:3])) == 1 and len(set(one[3:])) == 1 and one[0].startswith("49") and one[3].startswith("1")
    assert one[0] not in (re.sub(r"\D", "", phones[0]), two[0])


def test_national_numbers_keep_their_plan_and_are_linked(spark):
    """A number, its spelling with the country's code and that with a trunk zero lose the same digits to the same pseudonym; forms stay valid."""
    plan = re.compile("[2-9][0-9]{2}[2-9][0-9]{6}")
    same = [("+1 743 555 3824", "743 555 3824", "(743) 555-3824"), ("+44 20 7946 0958", "+44 (0)20 7946 0958", "(020) 7946 0958"), ("+44 7911 123456", "07911 123456", "07911/123456")]
    df = spark.createDataFrame([(i, j, t) for i, ts in enumerate(same) for j, t in enumerate(ts)], "i int, j int, text string")
    new = {(r["i"], r["j"]): r["__text"] for r in pseudonymized(df, "a key").select("__row.i", "__row.j", "__text").collect()}
    code = {0: "1", 1: "44", 2: "44"}
    for i, ts in enumerate(same):
        bodies = {re.sub(r"\D", "", new[i, j])[len(code[i]) if t.startswith("+") else 0 :].lstrip("0") for j, t in enumerate(ts)}
        assert len(bodies) == 1 and all(new[i, j] != t for j, t in enumerate(ts)), (ts, [new[i, j] for j in range(3)])
        assert all(new[i, j].startswith("+" + code[i]) for j, t in enumerate(ts) if t.startswith("+"))
    assert "(0)" in new[1, 1] and new[1, 2].startswith("(0") and new[2, 1].startswith("0") and plan.fullmatch(re.sub(r"\D", "", new[0, 1]))
    numbers = [f"{200 + k % 800} {200 + k * 7 % 800} {k:04d}" for k in range(600)] + [f"0{1000 + k * 13} {100000 + k * 997}" for k in range(600)]
    got = [r["__text"] for r in pseudonymized(spark.createDataFrame(list(enumerate(numbers)), "i int, text string").repartition(4), "a key").orderBy("__row.i").collect()]
    assert all(plan.fullmatch(x.replace(" ", "")) for x in got[:600]) and all(re.fullmatch("0[1-9][0-9]{3} [0-9]{6}", x) for x in got[600:])
    assert len(set(got)) == len(set(numbers)) and sum(a == b for a, b in zip(got, numbers, strict=True)) < 3
