from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runlens.llm import queries, sharding
from tests.conftest import SF_DIR

SCHEMA = "doc_id long, source string, more string"


def plainly(spark, rows: list[tuple], shards: int, seed: int = 1) -> list[tuple]:
    """Rank within sources, sort by fractions, cut: all in one list. Only the hashes are Spark's."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    strata = defaultdict(list)
    for r in df.collect():
        strata["" if r["source"] is None else f"={r['source']}"].append((r["h"], repr(r["doc_id"]), r["doc_id"], r["source"], r["more"]))
    names = spark.createDataFrame([(s,) for s in strata] or [("",)], "s string")
    phases = {r["s"]: (r["p"] % (1 << 32)) / float(1 << 32) for r in names.select("s", F.xxhash64(F.lit(seed), "s").alias("p")).collect()}
    mixed = []
    for name, members in strata.items():
        members.sort(key=lambda m: (m[0], m[1], m[4] or ""))
        mixed += [((rank + phases[name]) / len(members), name, rank, m[2:]) for rank, m in enumerate(members)]
    mixed.sort(key=lambda m: m[:3])
    out, total = [], len(mixed)
    for place, (_, _, _, row) in enumerate(mixed):
        shard = place * shards // total
        out.append((*row, shard, place - -(-shard * total // shards)))
    return out


def _check_laws(rows, shards: int) -> None:
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equals_a_sort_in_one_list(spark):
    # A source with most rows, one without a name, one of an empty name, and many of a single row.
    rows = [(i, "hot" if i % 3 else None if i % 2 else "", f"m{i}") for i in range(900)] + [(i, f"s{i}", None) for i in range(900, 1100)]
    got = sharding.interleave(spark.createDataFrame(rows, SCHEMA).repartition(7), 24).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plainly(spark, rows, 24), key=repr)
    _check_laws(got, 24)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else f"one of {i}", "") for i in range(4800)]
    sharded = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 24)
    per_shard = {(r["shard"], r["source"]): r["rows"] for r in sharding.mixture(sharded).collect()}
    # Sources of one row fall where their phase is; the others keep their proportion around them.
    assert all(abs(per_shard[s, "a"] - 2 * per_shard[s, "b"]) <= 3 for s in range(24))
    whole = sharding.mixture(sharding.interleave(spark.createDataFrame([r for r in rows if len(r[1]) == 1], SCHEMA), 24)).collect()
    assert all(abs(r["rows"] - (120 if r["source"] == "a" else 60)) <= 1 for r in whole)
    singles = Counter(s for (s, source), _ in per_shard.items() if source.startswith("one of"))
    assert min(singles.values()) >= 5 and max(singles.values()) <= 40


def test_the_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op12_shards(spark, SF_DIR).collect()
    assert len(rows) == len(docs) and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
    _check_laws(rows, queries.SHARDS)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op12_shards(spark, SF_DIR).repartition(3).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "a", "x")],
        [(1, None, None)] * 40,  # rows that repeat
        [(None, "a", "x"), (None, "a", "y"), (None, None, None), (2, "a", "x"), (2, "b", "x")],
    ],
)
def test_odd_tables(spark, rows):
    got = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(rows, key=repr)
    if rows:
        _check_laws(got, 24)


def test_written_shards_read_back_in_order(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "text " * (i % 5)) for i in range(100)]
    sharded = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 4)
    sharding.write_shards(sharded, str(tmp_path / "out"), rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out")).select(sharded.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sharded.collect()))


def test_clashing_names_are_refused(spark):
    for name in ("slot", "Shard", "_part"):
        df = spark.createDataFrame([(1, "a", 1)], f"doc_id long, source string, `{name}` int")
        with pytest.raises(ValueError, match=name):
            sharding.interleave(df, 4)
    with pytest.raises(ValueError, match="shard"):
        sharding.interleave(df.drop("_part"), 0)
