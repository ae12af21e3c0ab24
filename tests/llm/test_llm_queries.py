import pytest
from conftest import compare

from loamline.llm import queries as Q


def test_names():
    names = list(Q.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{n}" for n in range(1, 11)] and names[-1] == "pipeline"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    compare(Q.queries()[name](spark, sf_dir), Q.oracle_sql()[name], sf_dir)


def test_pipeline(spark, sf_dir):
    """The stages against plain loops over the same documents."""
    from test_dedup import near_expected

    from loamline.llm import packing, pii, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {}
    for r in docs.collect():
        longs, values = quality.statistics(r.text)
        if longs[0] >= 50 and 100 * longs[4] <= 50 * longs[0] and not any(all(values[f] >= v if least else values[f] <= v for f, least, v in rule) for rule in rules):
            rows[r.doc_id] = r.text
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t] == i}
    classes = near_expected(list(rows.items()))
    rows = {i: t for i, t in rows.items() if classes[i][0] == i}
    weights = pii.train(spark.createDataFrame(list(rows.items()), "doc_id bigint, text string"))
    masked = {i: pii.masked(t, pii.all_spans(t, weights, pii.base_spans(t))) for i, t in rows.items()}
    path = Q.vocabulary("byte_bpe_50k.json")
    tokens = {i: len(x) + 1 for i, x in zip(masked, packing.encode(path, list(masked.values())), strict=True)}
    got = Q.queries()["pipeline"](spark, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == tokens
    assert sum(r.length for r in got) == sum(tokens.values())
