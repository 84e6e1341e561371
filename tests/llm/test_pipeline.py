"""The corpus pipeline: each stage against a plain version of its decision, and the registered queries."""

import re
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from txrisk.llm.common import stash, table


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = [table(spark, data, "documents")]
    for _, f in corpus_pipeline.STAGES:
        docs.append(stash(f(spark, docs[-1], data)))
    return docs


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[1:-1])


def test_rejected_documents_are_the_low_ones(spark, data, stages):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, data, "labels").collect()}
    before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in stages[:2])
    gone = [labels[i] for i in before - after if i in labels]
    kept = [labels[i] for i in after if i in labels]
    assert after <= before and sum(gone) <= 0.1 * max(1, len(gone)) and kept.count(0) <= 0.1 * len(kept)


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: shingles(r["text"]) for r in stages[1].collect()}
    kept = {r["doc_id"] for r in stages[2].select("doc_id").collect()}
    up = {i: i for i in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert kept == {i for i in ids if top(i) == i}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_secrets_are_gone_and_the_rest_stays(stages):
    assert stages[3].count() == stages[2].count()
    for r in stages[3].collect():
        assert not re.search("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"]) and r["n_chars"] == len(r["text"])


def test_mix_keeps_every_document(stages):
    before = Counter(r["doc_id"] for r in stages[3].select("doc_id").collect())
    after = Counter(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert set(before) == set(after) and max(after.values()) <= 2


def test_every_reading_is_packed(stages):
    read = stages[4].count()
    packed = stages[5]
    assert packed.where("piece = 0").count() == read
    sizes = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sizes) <= 4096 and len(sizes) <= sum(r[1] for r in sizes) / 4096 + 2


def test_run_and_registry(spark, data, stages):
    assert corpus_pipeline.run(spark, data).count() == stages[5].count()
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, _file string, r int, label string"


def test_odd_rows_pass_all_stages(spark, data):
    good = table(spark, data, "documents").orderBy("doc_id").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "f", 1, None) for r in good]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None, None, "x")]  # repeated rows, and a copy without an id
    rows += [(10**6, None, None, None, None, None, 2, "y"), (10**6 + 1, "", "en", "s", 0, "", 3, "y"), (None, "  ", "en", "s", 2, "f", 4, "z")]
    rows += [(10**6 + 2, " ".join(f"word{k}" for k in range(60_000)), "en", "s", 1, "f", 5, None)]
    docs = stash(spark.createDataFrame(rows, ODD))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stash(stage(spark, before, data))
        assert after.columns == docs.columns and after.schema == docs.schema, name
        if name == "simhash_near_dedup":
            ids = [r["doc_id"] for r in after.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and 10**6 + 2 in ids
            assert sum(not (r["text"] or "").strip() for r in after.collect()) <= 1
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, data)
    assert packed.where("piece = 0").count() == before.count() and packed.agg({"length": "max"}).first()[0] <= 4096


def test_an_empty_table_stays_empty(spark, data):
    docs = stash(spark.createDataFrame([], ODD))
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, data))
        assert docs.count() == 0
