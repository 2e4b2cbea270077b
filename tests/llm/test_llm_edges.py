"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import random

import pytest

from leafmill.llm import bayes_jaccard, chat_collapse, lang_mixture, mix_schedule, norm_topk, permutation_ann, piece_stream, prefix_bpe, secret_cost, toxic_crf

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, score double, vec_id long, lang_pred string, taken long, size long, begin long, key string, n int, ids string, spans string"
LONG = "lorem ipsum dolor sit amet " * 20_000


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, 1, 1, 0.5, 3, "x", 7, 7, 7, "k", 1, "i", "s")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, "one two three four five six seven"), row(1, "one two three four five six seven"), row(2, None), row(3, ""), row(4, "   \n\t "), row(5, LONG), row(6, "One  two three four five six seven", None, None), row(7, "12 34 ..."), row(None, "no id here", "fr", "b"), row(8, "é😀 ñ \x00 　 x")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_documents_operators_keep_every_row(docs, none):
    empty_model = toxic_crf.ToxicModel()
    for run in (
        prefix_bpe.token_counts,
        piece_stream.encoded,
        piece_stream.round_trip,
        secret_cost.scanned,
        secret_cost.redacted,
        lambda d: toxic_crf.scored(d, empty_model),
        lang_mixture.language_query,
        mix_schedule.mix_query,
    ):
        assert run(docs).count() == docs.count()
        assert run(none).count() == 0


def test_values_of_odd_texts(docs):
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in prefix_bpe.token_counts(docs).collect()}
    assert counts[2] == counts[3] == (0, 0)
    assert all(r.exact for r in piece_stream.round_trip(docs).collect())
    found = {r.doc_id: r.lang_pred for r in lang_mixture.language_query(docs).collect()}
    assert found[2] == found[3] == found[4] == found[7] == "und" and found[1] != "und"
    taken = {r.doc_id: (r.size, r.taken) for r in mix_schedule.mix_query(docs).collect()}
    assert taken[2] == taken[3] == taken[4] == (0, 0) and taken[5][0] == 100_000


def test_near_duplicates(docs, none):
    rows = {r.doc_id: r for r in bayes_jaccard.near_duplicates(docs).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert rows[1].class_id == rows[6].class_id == 1 and rows[6].n_copies == 2 and rows[1].n_links == 0
    assert all(rows[i].class_id == i for i in (2, 3, 4, 5, 7, 8))
    assert bayes_jaccard.near_duplicates(none).count() == 0
    kept = sorted((r.doc_id for r in bayes_jaccard.one_of_each(docs).collect()), key=lambda v: (v is None, v or 0))
    assert kept == [1, 2, 3, 4, 5, 7, 8, None]


def test_toxicity_without_labels(docs, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxic_crf.toxicity_query(docs, labels).collect()} == {0}


def test_pipeline_stages(docs, none, spark):
    import corpus_pipeline

    for start in (docs, none):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns
            rows = rows.cache()
        out = corpus_pipeline.STAGES[-1][1](spark, rows, "")
        assert out.count() == rows.count()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 9), (0, [1.0, 0.0], 9), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [nan, 1.0], 1), (5, [1.0, None], 1), (6, [0.0, 0.0], 1), (7, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0], 1), (100, [-1.0, 0.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = [(i, v) for i, v, _ in rows if i in (0, 1, 2, 100)]

    def expected(good, queries, scale, k):
        """As the SQL has it: every pair of rows of different ids."""
        out = []
        for query in sorted({i for i, _ in good if i % queries == 0}):
            pairs = sorted((-sum(a * b for a, b in zip(u, v)) * scale, j) for i, u in good for j, v in good if i == query != j and len(u) == len(v))
            out += [(query, rank, j, -s) for rank, (s, j) in enumerate(pairs[:k], 1)]
        return out

    near = [(r.query_id, r["rank"], r.vec_id, r.score) for r in permutation_ann.nearest(table).orderBy("query_id", "rank").collect()]
    assert near == expected(good, 20, 1, 20)
    exact = [(r.query_id, r["rank"], r.vec_id, r.score) for r in norm_topk.top_products(table).orderBy("query_id", "rank").collect()]
    assert exact == expected([*good, (6, [0.0, 0.0]), (8, [1.0])], 100, 1024 * 1024, 10)
    other = table.unionByName(spark.createDataFrame([(200, [2.0], 1), (40, [0.5], 1)], table.schema))  # another dimension
    assert [(r.query_id, r.vec_id) for r in norm_topk.top_products(other).where("query_id = 200").orderBy("rank").collect()] == [(200, 8), (200, 40)]
    with pytest.raises(Exception, match="64 bits"):
        norm_topk.top_products(spark.createDataFrame([(0, [3e9]), (1, [3e9])], "vec_id long, embedding array<double>")).collect()
    for search in (permutation_ann.nearest, norm_topk.top_products):
        assert search(table.where("false")).count() == 0
        assert search(table.where("embedding IS NULL")).count() == 0


def test_vectors_in_several_blocks(spark, monkeypatch):
    for module in (norm_topk, permutation_ann):
        monkeypatch.setattr(module, "ROWS_IN_BLOCK", 64)
        monkeypatch.setattr(module, "QUERIES_IN_BLOCK", 3)
    rng = random.Random(5)
    rows = [(i % 590, [float(rng.randint(-2, 2)) * (1 + i % 7) for _ in range(3)]) for i in range(600)]  # many ties, ten repeated ids
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for found, every, k, scale in ((norm_topk.top_products(table, 100, 10), 100, 10, 1024 * 1024), (permutation_ann.nearest(table, 100, 10, share=1.0), 100, 10, 1)):
        for query in range(0, 590, 100):
            pairs = sorted((-sum(a * b for a, b in zip(u, v)) * scale, j) for i, u in rows for j, v in rows if i == query != j and (scale > 1 or any(u) and any(v)))
            assert [(r.vec_id, r.score) for r in found.where(f"query_id = {query}").orderBy("rank").collect()] == [(j, -s) for s, j in pairs[:k]]


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (5, None, "user", "x"), (5, 3, "user", "y"), (5, 5000, "user", "z"), (6, None, "user", "x"), (None, 0, "user", "q"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, run int")
    found = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat_collapse.maximal_chats(table).collect()}
    assert set(found) == {1, 4, 5, 7}
    assert found[1] == (2, 2, "<|user|>\na\n<|assistant|>\nb\n") and found[4] == (1, 1, "<||>\n\n") and found[5][0] == 3
    assert chat_collapse.maximal_chats(table.where("false")).count() == 0


def test_long_and_forged_chats(spark):
    """One conversation of 5,000 turns without numbers, one of 3,000 of one number, and snapshots of a third."""
    rows = [(1, None, "user", f"{i:05d}") for i in range(5000)] + [(2, 7, "user", f"b{i:05d}") for i in range(3000)]
    rows += [(10 + n, i, "user", f"turn {i}") for n in range(1, 40) for i in range(n)]
    rows += [(90, 0, "user", "x\n<|assistant|>\ny"), (91, 0, "user", "x"), (91, 1, "assistant", "y"), (92, 0, "a|>b", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: (r.n_turns, r.rendered) for r in chat_collapse.maximal_chats(table).collect()}
    assert set(found) == {1, 2, 49, 90, 91, 92} and found[49][0] == 39
    assert found[1] == (5000, "".join(f"<|user|>\n{i:05d}\n" for i in range(5000))) and found[2][0] == 3000
    assert found[90] == (1, "<|user|>\nx\n<\\|assistant|>\ny\n") and found[91][1] == "<|user|>\nx\n<|assistant|>\ny\n" and found[92][1] == "<|a\\|>b|>\nz\n"


def test_memories_are_told_apart_without_comparing_entries():
    from leafmill.llm.common import Memo

    assert (Memo(len, 1000) == Memo(len, 1000)) is False  # as dictionaries both are {}


def test_an_operator_forgets_what_another_left():
    from leafmill.llm.common import Memo, Shared

    shared, memory = Shared(), Memo(len, 1000)
    shared.used_by("a")
    memory["some"]
    shared.grown(memory)
    shared.used_by("a")
    assert memory.used
    shared.used_by("b")
    assert not memory and not memory.used


def test_portions_hold_every_row_once():
    import pyarrow as pa

    from leafmill.llm.common import portions

    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 30, "", "c" * 5], pa.string())})
    found = [p.column("text").to_pylist() for p in portions([batch, batch.slice(0, 0), batch.slice(2)], 12)]
    assert found == [["a" * 10, None], ["b" * 30], ["", "c" * 5], ["b" * 30], ["", "c" * 5]]


def test_a_task_bounds_the_memories_of_its_worker(monkeypatch):
    from pyspark import cloudpickle

    from leafmill.llm import common

    monkeypatch.setattr(common.shared, "limit", common.shared.limit)
    memory = common.Memo(len, 1000)
    memory["some"]
    common.shared.grown(memory)
    sent = cloudpickle.loads(cloudpickle.dumps(common.tidy(iter, 12_345, keep=False)))  # as tasks are sent to workers
    assert list(sent([7])) == [7]
    assert common.shared.limit == 12_345 and not memory
