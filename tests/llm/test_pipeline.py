"""Stages of the pipeline one by one against plain Python, then all of them together."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's documents and result over the smallest tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        result = pipeline.materialise(stage(spark, docs, SF))
        out[name] = (docs, result)
        docs = result
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == list(stages)
    for name, (docs, result) in list(stages.items())[:-1]:
        assert result.columns == docs.columns and result.dtypes == docs.dtypes, name


def test_toxic_documents_go(spark, stages):
    docs, kept = stages["toxicity"]
    scored = {r.doc_id: r.score for r in pipeline.toxicity.score(docs, pipeline.toxicity.train(
        docs, spark.read.parquet(f"{SF}/labels.parquet"),
        usable=pipeline.id_remainder(pipeline.F.col("doc_id"), 3) != 1)).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, s in scored.items() if s < 0.7)
    assert kept.count() > 0.7 * docs.count()


def test_boilerplate_goes(stages):
    docs, cut = stages["line dedup"]
    rows, pages, holds = docs.collect(), Counter(), Counter()
    for r in rows:
        pages[r.source] += 1
        holds.update({(r.source, line) for line in r.text.split("\n") if line.strip()})
    bad = {k for k, n in holds.items() if n >= 5 and n > 0.05 * pages[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x) not in bad) for r in rows}
    got = {r.doc_id: r for r in cut.collect()}
    assert {k: r.text for k, r in got.items()} == want
    changed = [r for r in rows if want[r.doc_id] != r.text]
    assert all(got[r.doc_id].n_chars == len(want[r.doc_id]) for r in changed)


def test_one_of_each_group_stays(stages):
    docs, kept = stages["n-gram jaccard join"]
    sets, parent = {}, {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        parent[r.doc_id] = r.doc_id

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in sets if find(k) == k)


def test_mix_is_near_its_targets(stages):
    docs, mix = stages["mixing sources"]
    size = {r.doc_id: len(r.text.encode().split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    times = Counter(r.doc_id for r in mix.collect())
    assert max(times.values()) <= 3 and set(times) <= set(size)
    total, taken = Counter(), Counter()
    for k, n in size.items():
        total[source[k]] += n
        taken[source[k]] += n * times[k]
    order = sorted(total)
    from tableloom.llm.mixing import targets

    goal = targets([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3.0)
    for s, t in zip(order, goal):
        assert abs(taken[s] - t) <= max(n for k, n in size.items() if source[k] == s)


def test_every_row_is_encoded(stages):
    docs, out = stages["bpe encoding and decoding"]
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = tool.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in out.collect()) == want


def test_run_is_all_stages(spark, stages):
    last = list(stages.values())[-1][1]
    assert Counter(map(str, pipeline.run(spark, SF).collect())) == Counter(map(str, last.collect()))


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 10), (3, "one two three", "en", "a", 13),
            (3, "one two three", "en", "a", 13), (4, "One two THREE", "en", "b", 13), (5, "x " * 40_000, "en", "b", 80_000)]
    docs = spark.createDataFrame(rows, COLUMNS)
    counts = []
    for _, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, SF))
        counts.append(docs.count())
    assert counts[0] == counts[1] == 7  # nothing toxic, no boilerplate
    assert counts[2] == 5  # 1, 2, null, 3, 5
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_unrelated_texts_under_one_id_stay(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    rows = [(3, a), (3, b), (3, c), (3, a), (9, b), (1, c), (None, a), (None, "lonely words without any number here"),
            (5, "same words for two rows here"), (5, "same words for two rows here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    kept = pipeline.without_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(3, a), (3, b), (1, c), (None, "lonely words without any number here"), (5, "same words for two rows here")]
    assert got == sorted(want, key=str)
    three = spark.createDataFrame([(3, t, "en", "s", len(t)) for t in (a, b, c)], COLUMNS)
    assert pipeline.without_near_copies(spark, three, SF).count() == 3
