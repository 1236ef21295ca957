"""Queries of the subpackage against their SQL, and the pipeline against its stages done plainly."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from facetry.llm import decontaminate
from facetry.llm.queries import DECONTAMINATION_SQL, MIX_SQL, QUERIES, SQL

from ..test_queries import ordered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    yield con
    con.close()


def same(ours, theirs):
    ours, theirs = ordered(ours), ordered(theirs)
    assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs) > 0
    for c in ours.columns:
        if ours[c].dtype.kind == "f":
            assert (ours[c].isna() == theirs[c].isna()).all()
            assert not (abs(ours[c] - theirs[c]) > 1e-6).any()
        else:
            assert (ours[c].astype(str) == theirs[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df())


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_removal(spark):
    docs = spark.createDataFrame([(1, "xx Alpha, beta gamma! yy"), (2, "alpha beta"), (3, None), (4, "é alpha beta gamma beta gamma")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "alpha beta GAMMA"), (8, "")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert cut == {1: "xx ! yy", 2: "alpha beta", 3: None, 4: "é  beta gamma"}


def test_stages(spark, duck, tmp_path):
    """Each stage on what the one before kept: quality against the operator's own tested result, near duplicates against all pairs of five-word sets, the
    others in SQL."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        kept[name] = path
        docs = spark.read.parquet(path)
        duck.execute(f"CREATE VIEW after_{name} AS SELECT * FROM '{path}/*.parquet'")
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda sql: sorted(r[0] for r in duck.execute(sql).fetchall())
    scores = QUERIES["op8_quality"](spark, SF).where("keep").select("doc_id").collect()
    assert ids("SELECT doc_id FROM after_quality") == sorted(r[0] for r in scores)
    from .test_brute_force import roots
    from .test_near_dedup import plain_similarity, plain_shingles

    rows = duck.execute("SELECT doc_id, text FROM after_quality ORDER BY doc_id").fetchall()
    sets = [plain_shingles(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if plain_similarity(sets[i], sets[j]) >= 0.8])
    assert ids("SELECT doc_id FROM after_near_duplicates") == [rows[i][0] for i in range(len(rows)) if root[i] == i]
    clean = DECONTAMINATION_SQL.format(docs="after_near_duplicates") + "SELECT doc_id FROM decon WHERE NOT contaminated"
    assert ids("SELECT doc_id FROM after_decontamination") == ids(clean)
    mixed = MIX_SQL.format(docs="after_decontamination") + "SELECT doc_id FROM mixed, range(copies)"
    assert ids("SELECT doc_id FROM after_mixing") == ids(mixed)
    assert ids("SELECT doc_id FROM after_sharding") == ids("SELECT doc_id FROM after_mixing")
    assert duck.execute("SELECT count(*) FROM (SELECT shard, slot FROM after_sharding GROUP BY ALL HAVING count(*) > 1)").fetchone()[0] == 0
    assert corpus_pipeline.run(spark, SF).count() == spark.read.parquet(kept["sharding"]).count()
