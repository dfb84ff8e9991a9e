import hashlib

import corpus_pipeline
from ramify.llm.queries import ORACLE_SQL, QUERIES

from ..compare import SMALL, same
from .conftest import awkward, make, prose
from .test_operators import check_packing, plain_kept, plain_removals, plain_similar, raw


def plain_pipeline(rows):
    """The stages one by one on lists of (id, text), each by brute force; nothing of the library is used."""
    rows = sorted(x for x in rows if plain_kept(x[1]))
    rows = [rows[i] for i in sorted(set(plain_similar(rows)))]
    gone = {i: (n, sha) for i, _, n, sha in plain_removals(rows)}
    return [(i, text, *gone[i]) for i, text in rows]


def natural(spark):
    """The documents of the smallest table, with near copies and passages that repeat."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    good = [t for _, t in sorted(rows) if plain_kept(t) and 200 < len(t.split()) < 900][:6]
    near = [" ".join([*t.split()[:90], "changed", *t.split()[91:]]) for t in good[:3]]
    shared = [f"{t} {good[5]}" for t in good[3:5]]
    return rows + [(10_000 + i, t) for i, t in enumerate([*near, *shared, None, "", prose(1, 5)])]


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = natural(spark)
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_pipeline(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert set(left) == {i for i, *_ in want} and not {10_000, 10_001, 10_002} & set(left)
    assert sum(gone > 0 for _, _, gone, _ in want) >= 2
    for i, text, gone, sha in want:
        assert left[i] == text if not gone else hashlib.sha256(raw(left[i])).hexdigest() == sha
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), sorted(left.items()))


def test_pipeline_of_nothing_and_of_awkward_rows(spark, tmp_path):
    good = next(t for _, t in natural(spark) if plain_kept(t) and len(t) < 4000)
    odd = [*awkward(), (None, good), (None, good), (7, good), (7, good), (8, good + " more")]
    for name, rows in (("none", []), ("odd", odd)):
        make(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()}
        assert got == (set() if not rows else {7})


def test_queries_over_the_small_tables(spark):
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
    for name, sql in ORACLE_SQL.items():
        same(QUERIES[name](spark, SMALL), sql)
