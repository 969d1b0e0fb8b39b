"""The battery of the secret scan: single keys among ordinary identifiers, and false finds."""

import random
import string

import pytest

from netquarry.llm.secret_scan import find_secrets

SCHEMA = "doc_id long, text string, base string, tested string, runs string"
ALPHABETS = {
    "hex_upper": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base62": string.ascii_letters + string.digits,
    "base64": string.ascii_letters + string.digits + "+/",
}
IDENTIFIERS = [
    "configuration_parameter_list_2", "aaaaaaaaaaaaaaaaaaaaaaaa1", "getUserAccountBalance2ForMonth", "ThisIsAnOrdinaryIdentifier1",
    "organisation/repository/branch1", "some-long-hyphenated-name-3", "1111222233334444555566667777", "ABABABABABABABABABABABAB22",
]


def key(rnd, alphabet, length):
    while True:
        found = "".join(rnd.choice(alphabet) for _ in range(length))
        if any(c.isdigit() for c in found) and any(c.isalpha() for c in found):
            return found


def scan(spark, texts):
    rows = [(k, t, "b", "t", "r") for k, t in enumerate(texts)]
    return {r["doc_id"]: r["spans"] for r in find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def test_single_keys_are_found(spark):
    rnd, found, wanted = random.Random(1), 0, 0
    for trial in range(6):
        keys = [key(rnd, a, rnd.choice([32, 40, 64])) for a in ALPHABETS.values()]
        spans = scan(spark, [f"x {k} y" for k in keys] + [f"see {name} there" for name in IDENTIFIERS])
        wanted += len(keys)
        found += sum(spans[i] == f"random:2:{2 + len(k)}" for i, k in enumerate(keys))
    assert found >= 0.9 * wanted


@pytest.mark.parametrize("copies", [1, 200])
def test_false_finds_do_not_grow(spark, copies):
    rnd = random.Random(copies)
    words = ["".join(rnd.choice(["ta", "ri", "no", "le", "Ko", "Su"]) for _ in range(12)) + str(rnd.randrange(10)) for _ in range(8 * copies)]
    spans = scan(spark, [f"a {w} b" for w in words])
    assert sum(bool(s) for s in spans.values()) <= max(4, 0.1 * len(words))


def test_odd_texts(spark):
    long = "plain words " * 40_000 + "password=hunter2secret"
    spans = scan(spark, [None, "", "token: abcdef", long, "AKIA" + "A" * 16, "0a" * 12])
    assert spans[0] == spans[1] == "" and spans[2] == "assign:0:13"
    assert spans[3] == f"assign:{len(long) - 22}:{len(long)}" and spans[4] == "access:0:20" and spans[5] == "hex:0:24"
    assert find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
