import itertools

import pytest

from larkspur.operators.orphans import failed_references, hot_keys, orphan_keys, salted_join


def brute(refs, keys, match):
    out = set()
    for r in set(refs):
        given = [i for i, v in enumerate(r) if v is not None]
        if len(given) < len(r):
            if match == "simple" or not given:
                continue
            if match == "full":
                out.add(r)
                continue
        if not any(all(k[i] == r[i] for i in given) for k in keys):
            out.add(r)
    return out


@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_match_semantics(spark, match):
    values = [None, "a", "b", "c"]
    refs = list(itertools.product(values, values)) * 2
    keys = [("a", "a"), ("b", None), ("a", "c"), (None, "b")]
    full = [k for k in keys]
    schema = "x string, y string"
    got = {(r.x, r.y) for r in orphan_keys(spark.createDataFrame(refs, schema), spark.createDataFrame(keys, schema), ["x", "y"], match).collect()}
    assert got == brute(refs, full, match)


def test_counts_and_empty(spark):
    refs = spark.createDataFrame([("a",), ("a",), ("z",)], "x string")
    keys = spark.createDataFrame([], "x string")
    assert {(r.x, r.n_refs) for r in orphan_keys(refs, keys, ["x"]).collect()} == {("a", 2), ("z", 1)}
    assert orphan_keys(refs.limit(0), keys, ["x"]).count() == 0
    with pytest.raises(ValueError):
        orphan_keys(refs, keys, ["x"], "other")


def test_salted_join_equals_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else str(i % 7)) for i in range(300)], "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("0", 2), ("3", 3)], "k string, v int")
    plain = sorted(map(tuple, big.join(small, "k", "left").select("id", "k", "v").collect()), key=str)
    assert sorted(map(tuple, salted_join(big, small, ["k"], by="id").select("id", "k", "v").collect()), key=str) == plain


def test_more_than_eight_columns(spark):
    names = [f"c{i}" for i in range(12)]
    schema = ", ".join(f"{c} string" for c in names)
    refs = [tuple("x" if i != j else None for i in range(12)) for j in range(12)] + [tuple("y" * 12), (None,) * 12]
    keys = [tuple("x" * 12)]
    got = {(tuple(r[c] for c in names), r.null_mask) for r in orphan_keys(spark.createDataFrame(refs, schema), spark.createDataFrame(keys, schema), names, "partial").collect()}
    assert got == {(tuple("y" * 12), "0" * 12)}
    assert orphan_keys(spark.createDataFrame(refs, schema), spark.createDataFrame(keys, schema), names, "full").count() == 13


def test_kinds_of_failure(spark):
    refs = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5), (4, "d", 5), (5, None, 5), (6, "a", 1), (7, "a", 5), (8, "e", None)], "id int, k string, seen int")
    keys = spark.createDataFrame([("a", 3), ("a", 2), ("c", 9), ("d", 1), ("e", 1)], "k string, stored int")
    gone = spark.createDataFrame([("d", 4), ("d", 8), ("b", 9)], "k string, removed int")
    got = {(r.id, r.kind) for r in failed_references(refs, keys, gone, ["k"], "seen", "stored", "removed", by="id", hot=refs.select("k").limit(1)).collect()}
    assert got == {(2, "missing"), (3, "late"), (4, "deleted"), (6, "late")}
    assert failed_references(refs, keys.limit(0), gone.limit(0), ["k"], "seen", "stored", "removed", by="id").filter("kind = 'missing'").count() == 7


def test_only_hot_keys_are_repeated(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(3000)], "id int, k string")
    assert [r.k for r in hot_keys(big, ["k"]).collect()] == ["hot"]
    assert hot_keys(big.limit(0), ["k"]).count() == 0
