"""Each operator against the library, a brute-force version, a round trip or held-out labels."""

import hashlib
import itertools
import json
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leafmill.llm import bayes_jaccard, components, lang_mixture, mix_schedule, norm_topk, permutation_ann, piece_stream, prefix_bpe, secret_cost, toxic_crf
from leafmill.llm.common import held_out, read_table

SMALL = "/root/testdata/sf0.01"
LETTERS = ["a", "b", "the ", "  ", "'re", "\n", "\t", ".", "0", "é", "<|endoftext|>", "日", " ", "==", "-"]


def odd_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, SMALL, "documents").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def test_token_counts_equal_the_library(documents, texts):
    library = Tokenizer.from_file(prefix_bpe.default_path())
    for r in prefix_bpe.token_counts(documents).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)


def test_prefix_counts_equal_encoding_each_prefix(texts):
    library, counter = Tokenizer.from_file(prefix_bpe.default_path()), prefix_bpe.counter(prefix_bpe.default_path())
    odd = [*odd_texts(120, 3), "a\x1c b\x85 c", "x \u3000 y", "it's we've  \n they'll", *(t[:150] for t in list(texts.values())[:30])]
    for text in odd:
        counts = counter.table(text).tolist()
        assert counts == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        for budget in (0, 1, 10, 1000):
            kept, n = counter.truncate(text, budget)
            assert len(kept) == max(k for k, c in enumerate(counts) if c <= budget) and n == counts[len(kept)]


def test_pairs_of_tokens_are_judged_as_by_merging():
    counter, rnd = prefix_bpe.counter(prefix_bpe.default_path()), random.Random(5)
    assert counter.one_way
    stand = [t for t in counter.vocabulary if counter.stands[t]]
    like = [t for t in stand if len(set(t)) < 3]  # runs of one symbol, where equal merges compete
    pairs = [(rnd.choice(some), rnd.choice(some)) for some in (stand, like) for _ in range(4000)]
    pairs += [(t[:at], t[at:]) for t in stand[-2000:] for at in range(1, len(t)) if counter.stands[t[:at]] and t[at:] in counter.vocabulary]
    assert len({counter.apart(*pair) for pair in pairs}) == 2
    assert all(counter.apart(a, b) == (counter.merged(a + b) == [a, b]) for a, b in pairs)


def test_vocabularies_with_two_ways_to_a_token_are_merged(tmp_path):
    tokens = [*prefix_bpe.byte_alphabet(), "ab", "bc", "abc"]
    merges = [["b", "c"], ["a", "b"], ["ab", "c"], ["a", "bc"]]
    spec = {"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}}
    (tmp_path / "two.json").write_text(json.dumps(spec))
    counter, library = prefix_bpe.PrefixCounter(str(tmp_path / "two.json")), Tokenizer.from_file(str(tmp_path / "two.json"))
    assert not counter.one_way
    for text in map("".join, itertools.product("abc", repeat=6)):
        assert counter.table(text).tolist() == [len(library.encode(text[:k]).ids) for k in range(7)]


def test_truncated_rows(spark):
    library = Tokenizer.from_file(prefix_bpe.default_path())
    rows = [(1, "one two three", 1), (1, "one two three", 1), (2, None, 1), (3, "", 1), (None, "é😀 " * 50, 1), (4, "日本" * 300, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    whole = {(d, t or "") for d, t, _ in rows}
    for budget in (0, 2, 40):
        out = prefix_bpe.truncated(table, budget).collect()
        assert len(out) == len(rows)
        for r in out:
            text = next(t for d, t in whole if d == r.doc_id)
            n = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
            assert text.startswith(r.text) and len(r.text) == max(k for k, c in enumerate(n) if c <= budget) and r.n_tokens == n[len(r.text)]
    assert prefix_bpe.truncated(table.where("false"), 5).count() == 0


def test_pieces_equal_the_library(texts):
    library, own = sentencepiece.SentencePieceProcessor(model_file=piece_stream.default_path()), piece_stream.model(piece_stream.default_path())
    for text in [*odd_texts(200, 5), *list(texts.values())[:200], "a" * 5000, " " * 99, "aeroplane" * 400]:
        ids = own.encode(text)
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)


def test_ids_come_from_commits_in_a_bounded_window(texts):
    own = piece_stream.model(piece_stream.default_path())
    for text in ["aeroplane==representation\n" * 100, *odd_texts(20, 8), *list(texts.values())[:10]]:
        stream, state, committed, widest = piece_stream.StreamingViterbi(own), own.tables.start, [], 0
        for letter in own.prepared(text):
            ids = stream.push(letter)
            state, packed = state[letter]
            assert np.frombuffer(packed, "<i4").tolist() == ids  # the tables hold what the search commits
            assert stream.alive[-1] == len(stream.window) and len(stream.window) - stream.alive[0] <= own.longest
            widest = max(widest, len(stream.window))
            committed += ids
        assert committed + stream.commit(final=True) == own.encode(text)
        assert widest <= 2 * own.longest


def test_full_tables_change_nothing(texts, monkeypatch):
    pieces = piece_stream.model(piece_stream.default_path())
    monkeypatch.setattr(piece_stream, "TABLE_BYTES", 20_000)
    tables, pieces.tables = pieces.tables, piece_stream.Tables(pieces)
    small = [pieces.encode(t) for t in list(texts.values())[:20]]
    pieces.tables = tables
    assert small == [pieces.encode(t) for t in list(texts.values())[:20]]


def test_decoded_rows(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "é😀", None)], "doc_id long, text string, decoded string")
    back = piece_stream.decoded(piece_stream.encoded(rows))
    assert sorted((r.doc_id, r.decoded) for r in back.collect()) == [(1, "a b"), (1, "a b"), (2, ""), (3, "é😀")]
    assert piece_stream.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == ""


def test_unigram_path_has_the_best_score():
    rnd = random.Random(1)
    pieces = {"<unk>": ("<unk>", 0.0, piece_stream.UNKNOWN)} | {c: (c, -3 - rnd.random(), 1) for c in "abc▁"}
    for _ in range(40):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 4)))
        pieces.setdefault(t, (t, -rnd.uniform(2, 8), 1))
    own = piece_stream.PieceModel(list(pieces.values()), piece_stream.UNIGRAM)
    for _ in range(60):
        text = "".join(rnd.choice("abcabcabc ") for _ in range(150))
        marked = own.prepared(text)
        best = [0.0] + [-1e18] * len(marked)
        for end in range(1, len(marked) + 1):
            for begin in range(max(0, end - own.longest), end):
                best[end] = max(best[end], best[begin] + own.score.get(marked[begin:end], -1e18))
        ids = own.encode(text)
        assert own.decode(ids) == text
        assert sum(own.score[own.texts[i]] for i in ids) == pytest.approx(best[-1])


def base(text):
    kinds = (("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2), ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0), ("hex", re.compile(r"[0-9a-f]+"), 32, 0))
    found = [(m.start(), k, m.end(), name) for k, (name, p, least, g) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
    return ",".join(f"{name}:{b}:{e}" for b, _, e, name in sorted(found))


def test_base_spans(documents, texts):
    found = 0
    for r in secret_cost.scanned(documents).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        found += bool(want)
    assert found > 5


def test_guess_cost():
    cost = lambda v: secret_cost.segments_cost(v)[0]
    for weak in ("password123", "Passw0rd2024", "changeme", "qwertyuiop1234", "2024-01-31", "aaaaaaaaaaaa"):
        assert cost(weak) < 7
    for strong in ("8f3kLq9Zx2", "b7db7aa4a5fcc78305", "x9$Tq!vz0Lm"):
        assert cost(strong) > 12
    spans = secret_cost.spans_of("pwd: x9$Tq!vz0Lm and pwd: changeme and secret=abcdefgh1")
    assert [(secret_cost.KINDS[k], b, e) for b, k, e in spans] == [("guess", 5, 16), ("assign", 39, 55)]
    assert secret_cost.redacted_text("a pwd: x9$Tq!vz0Lm b", secret_cost.spans_of("a pwd: x9$Tq!vz0Lm b")) == "a pwd: [SECRET] b"


def test_long_values_whole():
    rng = random.Random(7)
    for n in (6, 257, 5000):
        value = "".join(rng.choices("abcXYZ0189!#$%&*+/@^_|~", k=n)) + "9zQ"
        text = f"private_key = {value} end"
        assert secret_cost.spans_of(text) == [(14, 3, 14 + len(value))]
        assert secret_cost.redacted_text(text, secret_cost.spans_of(text)) == "private_key = [SECRET] end"
    assert secret_cost.spans_of(f"passphrase: {'x' * 5000}") == []
    parts = ["password", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "20240131", "qwertyuiopqwertyuiop", "abcabcabc", "x9$T", "Q!v", "summer"]
    for _ in range(300):
        value = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        for least in (3.0, 9.0, 20.0):
            assert secret_cost.takes(value, least) == (secret_cost.segments_cost(value)[0] >= least)


def exhaustive_cost(value):
    """The cheapest of all segmentations, each span by each kind."""
    c, letter, rank, lower = secret_cost, secret_cost.letter_cost(value), secret_cost.ranks(secret_cost.default_vocabulary()), value.lower()

    def kinds(begin, end):
        span, size = lower[begin:end], end - begin
        pairs = [span[i : i + 2] for i in range(size - 1)]
        yield size * letter
        if size >= 3:
            yield c.word_cost(value[begin:end], rank)
            if all(p in c.WALKS for p in pairs):
                yield c.WALK_COST
            if len(set(span)) == 1:
                yield letter + c.RUN_COST
        if c.DATE.fullmatch(value[begin:end]):
            yield c.DATE_COST
        if 2 <= size <= c.LONGEST_BLOCK and lower[begin - size : begin] == span and begin >= size:
            yield c.BLOCK_COST

    best = np.inf
    for cuts in itertools.product((False, True), repeat=len(value) - 1):
        at = [0, *(i + 1 for i, cut in enumerate(cuts) if cut), len(value)]
        best = min(best, sum(min(kinds(a, b)) for a, b in zip(at, at[1:])) + (len(at) - 2) * c.SPAN_COST)
    return best


def test_cheapest_of_all_segmentations():
    rng = random.Random(11)
    parts = ["abc", "fgh", "zz", "p4ss", "the", "Me", "19", "20", "01", "x9", "$", "qwe", "ab", "2024"]
    for _ in range(120):
        value = "".join(rng.choices(parts, k=5))[:10]
        cost, cuts = secret_cost.segments_cost(value)
        assert cost == pytest.approx(exhaustive_cost(value)), value
        assert [c[1] for c in cuts] == [0, *(c[2] for c in cuts[:-1])] and cuts[-1][2] == len(value)
    assert secret_cost.segments_cost("changemefgh")[0] < 5


def test_cost_decides():
    for text, value in (
        ("password: $Xk9#mQ2!vL7p", "$Xk9#mQ2!vL7p"),
        ("pwd: [k9#mQ2!vL7p", "[k9#mQ2!vL7p"),
        ("pwd=qzxkvjwmtrplhdbn", "qzxkvjwmtrplhdbn"),
        ("pwd=Qzxkvjwmtrplhdbn", "Qzxkvjwmtrplhdbn"),
        ("Authorization: Bearer tk-9fQ2.xLz7Vw and", "tk-9fQ2.xLz7Vw"),
        ("authorization: Basic dXNlcjpwOTkx", "dXNlcjpwOTkx"),
        ("sent as Bearer tk-9fQ2.xLz7Vw", "tk-9fQ2.xLz7Vw"),
        ("dbPassword = p@s#W0!rd9Z", "p@s#W0!rd9Z"),
        ("userPass: p@s#W0!rd9Z", "p@s#W0!rd9Z"),
    ):
        begin = text.index(value)
        assert (begin, 3, begin + len(value)) in secret_cost.spans_of(text), text
        assert secret_cost.candidates(pa.array([text])) == [True], text
    for text in ("pwd: ${DB_PASSWORD}", "pwd: {{vault.db}}", "pwd: %(secret_name)s", "pwd: changeme", "Authorization: Bearer", "compass: q9#mQ2!vL7p", "pwd: [REDACTED]"):
        assert secret_cost.spans_of(text) == [], text


def jaccard_classes(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    links = {}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                n = len(x & y)
                if 5 * n >= 4 * (len(x) + len(y) - n):
                    links.setdefault(a, set()).add(b)
                    links.setdefault(b, set()).add(a)
    least = {d: d for d in ids}
    changed = True
    while changed:
        changed = False
        for a, others in links.items():
            m = min(least[x] for x in (a, *others))
            for x in (a, *others):
                changed |= least[x] != m
                least[x] = m
    return least, {d: len({sets[o] for o in links.get(d, ()) if sets[o] != sets[d]}) for d in ids}


def test_near_duplicates_equal_brute_force(documents, texts, spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    extra = []
    for at in range(12):
        body = [rnd.choice(words) for _ in range(rnd.choice([6, 40, 150]))]
        for copy in range(6):
            other = list(body)
            for _ in range(copy):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            extra.append((10_000 + 10 * at + copy, " ".join(other)))
    sample = {d: t for d, t in texts.items() if d < 250} | dict(extra)
    least, links = jaccard_classes(sample)
    rows = bayes_jaccard.near_duplicates(spark.createDataFrame(list(sample.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {d: (least[d], links[d]) for d in sample}


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    left = rng.integers(0, 65536, (4000, bayes_jaccard.HASHES), dtype="u2")
    right = np.where(rng.random(left.shape) < 0.8, left, left + np.uint16(1))
    assert bayes_jaccard.surviving(left, right, bayes_jaccard.least_matches()).all()
    far = np.where(rng.random(left.shape) < 0.3, left, left + np.uint16(1))
    assert bayes_jaccard.surviving(left, far, bayes_jaccard.least_matches()).mean() < 0.001
    assert bayes_jaccard.misses(0.8) < 1e-6


def test_large_group_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(bayes_jaccard, "GROUP_CHUNK", 16)
    monkeypatch.setattr(bayes_jaccard, "BUCKET_CHUNK", 16)
    body = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*body[:99], f"x{i}"])) for i in range(60)]
    found = bayes_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in found} == {(0, 59)}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)]
    least = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: v for n, v in least.items() if n != v}


def test_languages_on_held_out_documents(documents):
    rows = lang_mixture.language_query(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_word_scores_against_single_grams():
    model = lang_mixture.LanguageModel(["a", "b"], np.random.default_rng(1).random((lang_mixture.BUCKETS, 2)).astype("f4"), np.zeros(2))
    factors, words = [int(f) for f in lang_mixture.FACTORS], ["a", "of", "straße", "日本語", "x" * 4096, "of"]

    def by_hand(word):
        marked = [ord(c) for c in f"<{word}>"]
        sums = [a * factors[0] + b * factors[1] for a, b in zip(marked, marked[1:])]
        sums += [a * factors[2] + b * factors[3] + c * factors[4] for a, b, c in zip(marked, marked[1:], marked[2:])]
        sums.append(sum(c * factors[5] ** (i + 1) for i, c in enumerate(marked)))
        return sum(model.table[x % 2**64 >> 47].astype("f8") for x in sums) / 2

    assert np.allclose(model.word_scores(words), [by_hand(w) for w in words], rtol=1e-4)
    assert lang_mixture.LETTERS.findall("y" * 9000) == ["y" * 4096, "y" * 4096, "y" * 808]
    long = " ".join(f"word{chr(97 + i % 26) * (i % 9)}{chr(97 + i // 26 % 26)}" for i in range(3000))
    alone = model.predict([long], 3.0, 12)
    assert model.predict(["of", long, None], 3.0, 12)[1][1] == alone[1][0]


def test_mixture_of_languages(documents):
    model = lang_mixture.train(documents.where(~held_out("doc_id")))
    by = {r.lang: r.text for r in documents.where("n_chars BETWEEN 1500 AND 3000").collect()}
    for a, b in (("en", "fr"), ("de", "es")):
        (label,), _, (parts,) = model.predict([" ".join(by[a].split()[:150] + by[b].split()[:50])], 3.0, 20)
        assert label == a and {p for p, _ in parts} == {a, b} and dict(parts)[b] == pytest.approx(0.25, abs=0.06)
    rows = np.log(np.array([[0.7, 0.1], [0.1, 0.7], [0.4, 0.4]]))
    share, value = model.proportions(rows, 50)
    assert share == pytest.approx([0.5, 0.5]) and value == pytest.approx(3 * np.log(0.4))


def test_toxicity_on_held_out_documents(documents, spark):
    labels = read_table(spark, SMALL, "labels")
    rows = toxic_crf.toxicity_query(documents, labels).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.toxic for r in rows])
    assert right > 0.92 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.score for r in rows if r.toxic]) > 0.5 > np.mean([r.score for r in rows if not r.toxic])


def test_forward_backward():
    rng = np.random.default_rng(0)
    counts = np.array([0, 3, 130, 1, 64, 65])
    score, start, step = rng.normal(-1, 3, counts.sum()), np.array([0.9, 0.1]), np.exp(rng.normal(0, 1, (2, 2)))
    got, at = toxic_crf.Blocks(counts).marginals(score, start, step), 0
    for n in counts:
        weight = np.exp(score[at : at + n])
        ahead = [start]
        for t in range(n):
            v = (ahead[-1] @ step) * [1, weight[t]]
            ahead.append(v / v.sum())
        back = np.ones(2)
        for t in range(n - 1, -1, -1):
            both = ahead[t + 1] * back
            assert got[at + t] == pytest.approx(both[1] / both.sum())
            back = step @ (back * [1, weight[t]])
            back /= back.sum()
        at += n


def test_recall_and_exact_products(spark):
    table = read_table(spark, SMALL, "embeddings")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], "f8")
    found = {}
    for r in permutation_ann.nearest(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        order = [i for i in np.lexsort((ids, -(x @ x[q]))) if i != q][:20]
        recall.append(len(found[ids[q]] & set(ids[order])) / 20)
    assert np.mean(recall) >= 0.9
    whole = np.floor(x * 1024).astype("i8")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in norm_topk.top_products(table).collect()}
    for q in np.flatnonzero(ids % 100 == 0):
        s = whole @ whole[q]
        for rank, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:10], 1):
            assert got[ids[q], rank] == (ids[i], s[i])


def test_exact_products_with_spread_lengths():
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(0, 300, (3000, 12)) * rng.exponential(1, (3000, 1)))
    ids = rng.permutation(3000)
    turn = np.linalg.eigh(rows.T @ rows)[1][:, ::-1]
    q, v, s = norm_topk.search_block(ids[:20], rows[:20], ids, rows, turn, 10)
    for at in range(20):
        scores = rows.astype("i8") @ rows[at].astype("i8")
        want = [i for i in np.lexsort((ids, -scores)) if i != at][:10]
        mine = q == ids[at]
        assert sorted(zip(-s[mine], v[mine], strict=True)) == [(-scores[i], ids[i]) for i in want]


def test_targets_and_schedule(spark, documents):
    t = mix_schedule.targets([("a", 100), ("b", 1000), (None, 10), ("c", 500)])
    assert [x.source for x in t] == ["a", "b", "c", None]
    assert sum(x.target for x in t) == pytest.approx(1.5 * 1610) and all(x.target <= 2 * x.size for x in t)
    assert t[0].target == 200 and t[1].target / t[2].target == pytest.approx(2)
    slots = [r.place for r in mix_schedule.schedule(spark, t, 10).orderBy("slot").collect()]
    assert [slots.count(i) for i in range(4)] == [-(-x.quota // 10) for x in t]
    early = slots[: len(slots) // 4]
    for i, x in enumerate(t):  # any stretch is near the shares
        assert early.count(i) / len(early) == pytest.approx(x.target / 2415, abs=0.06)


def test_blocks_hold_what_is_taken(documents):
    rows = mix_schedule.mix_query(documents).collect()
    pieces = mix_schedule.mixed_blocks(documents)
    words = {r.doc_id: r.n for r in pieces.selectExpr("doc_id", "last_word - first_word AS w").groupBy("doc_id").agg({"w": "sum"}).toDF("doc_id", "n").collect()}
    assert {r.doc_id: r.taken for r in rows if r.taken} == words
    assert all(r.taken <= 2 * r.size for r in rows)


def test_resampled_follows_the_slots(spark):
    rng = random.Random(3)
    rows = [(i % 300, f"{i % 300}" + "".join(rng.choices([" ", "\n", "  "])[0] + "w" for _ in range((i % 300) * 7 % 41 if i % 300 % 50 else 900)), "abc"[i % 3]) for i in range(330)]
    rows = [*rows, rows[0], (None, "no id here", None), (None, "another text", None), (9, None, "a"), (None, "", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [tuple(r) for r in mix_schedule.resampled(frame, 16).collect()]
    size = lambda text: len(re.findall(mix_schedule.WORD, text or ""))
    wanted = mix_schedule.targets([(s, sum(size(t) for _, t, x in rows if x == s)) for s in ("a", "b", "c", None)])
    for t in wanted:
        assert sum(size(r[1]) for r in out if r[2] == t.source) == t.quota
    assert len({r for r in out} - set(rows)) <= len(wanted)  # only the last of a source is cut
    for doc_id, text, source in out:
        assert any(d == doc_id and s == source and t and t.startswith(text) for d, t, s in rows)
    pieces = mix_schedule.mixed_blocks(frame, 16).where("first_word = 0").orderBy("slot").select("doc_id", "slot").collect()
    assert sorted(str(r[0]) for r in out) == sorted(str(r.doc_id) for r in pieces)
    at = {}
    for r in pieces:
        at.setdefault(r.doc_id, set()).add(r.slot)
    low = 0
    for doc_id, *_ in out:  # slots never go down
        low = min(s for s in at[doc_id] if s >= low)


def plain_language(model, text, penalty=3.0, rounds=12):
    """(label, score) by the definition: every word's grams one by one, every mixture by EM."""
    f, factors = np.float64, [int(x) for x in lang_mixture.FACTORS]

    def score(word):
        c = [ord(x) for x in f"<{word}>"]
        sums = [a * factors[0] + b * factors[1] for a, b in zip(c, c[1:])] + [a * factors[2] + b * factors[3] + d * factors[4] for a, b, d in zip(c, c[1:], c[2:])]
        sums.append(sum(x * factors[5] ** (i + 1) for i, x in enumerate(c)))
        return sum(model.table[x % 2**64 >> 47].astype(f) for x in sums) / 2

    words = [m[0] for part in (text or "").split() for m in re.finditer(r"[^\W\d_]{1,4096}", "".join(x if unicodedata.category(x)[0] != "N" else " " for x in part.lower()))]
    if not words:
        return "und", 0.0
    rows = np.array([score(w) for w in words])
    total = rows.sum(0) + model.prior
    first = int(total.argmax())
    chosen, share, value, cost = [first], [1.0], rows[:, first].sum(), penalty * np.log(len(words) + 1) + penalty
    while len(chosen) < len(model.languages):
        tried = []
        for c in set(range(len(model.languages))) - set(chosen):
            weight, p = np.exp(rows[:, [*chosen, c]] - rows.max(1, keepdims=True)), np.full(len(chosen) + 1, 1 / (len(chosen) + 1))
            for _ in range(rounds):
                p = (weight * p / (weight @ p)[:, None]).mean(0)
            tried.append((rows.max(1).sum() + np.log(weight @ p).sum(), c, p))
        best = max(tried, key=lambda t: t[0])
        if best[0] - value <= cost:
            break
        value, share, chosen = best[0], best[2], [*chosen, best[1]]
    odds = np.exp(total - total.max())
    return model.languages[chosen[int(np.argmax(share))]], float(odds[first] / odds.sum() if len(chosen) == 1 else max(share))


def test_languages_equal_a_plain_version(documents):
    model = lang_mixture.train(documents.where(~held_out("doc_id")))
    some = documents.where("n_chars < 3000 AND doc_id % 7 = 0")
    texts = {r.doc_id: r.text for r in some.collect()} | {-1: "² ½ ①", -2: "Ⅷ", -3: None, -4: "12 ab² cd"}
    frame = documents.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in lang_mixture.identify(frame, model).collect():
        label, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == label and r.score == pytest.approx(score, abs=1e-3), r.doc_id
        assert (r.lang_pred == "und") == (r.doc_id in (-1, -2, -3))


def test_toxicity_equals_a_plain_version(documents, spark):
    labels = read_table(spark, SMALL, "labels")
    model = toxic_crf.train(documents.select("doc_id", "text"), labels.where(~held_out("doc_id")))
    texts = {r.doc_id: r.text for r in documents.where("n_chars < 2000 AND doc_id % 5 = 0").collect()} | {-1: None, -2: "", -3: "12 ..."}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in toxic_crf.scored(frame, model).collect():
        weight = [np.exp(np.clip(model.bias + sum(float(model.weights[toxic_crf.bucket(t)]) for t in toxic_crf.traits(toxic_crf.core(w))), -40, 40)) for w in (texts[r.doc_id] or "").split()]
        ahead, back, toxic = [model.start], np.ones(2), []
        for x in weight:
            v = (ahead[-1] @ model.step) * [1, x]
            ahead.append(v / v.sum())
        for v, x in zip(ahead[:0:-1], weight[::-1]):
            toxic.append((v * back)[1] / (v * back).sum())
            back = model.step @ (back * [1, x])
            back /= back.sum()
        found = [1, np.log(sum(t for t in toxic if t >= 0.01) + 1e-3), -np.log(1e4)]
        if toxic:
            top = np.clip(max(toxic), 1e-4, 1 - 1e-4)
            found[2] = np.log(top / (1 - top))
        else:
            found[1:] = np.log(1e-3), np.log(1e-4)
        score = 1 / (1 + np.exp(-np.dot(found, model.judge)))
        assert r.score == pytest.approx(score, abs=1e-6) and r.predicted == (score >= 0.3)
        assert sum(len(texts[r.doc_id][s.begin : s.end].split()) for s in r.spans) == sum(t >= 0.5 for t in toxic)


def test_pipeline_stages_equal_plain_versions(spark):
    import corpus_pipeline

    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    stages, rows = dict(corpus_pipeline.STAGES), {r.doc_id: r for r in docs.collect()}
    one = stages["language_id"](spark, docs, "").cache()
    model = lang_mixture.train(docs.where(~held_out("doc_id")))
    short = [d for d, r in rows.items() if len(r.text or "") < 4000]
    got = {r.doc_id: r.lang for r in one.collect()}
    assert {d: got.get(d, "und") for d in short} == {d: plain_language(model, rows[d].text)[0] for d in short}
    two = stages["ngram_jaccard"](spark, one, "").cache()
    kept = {r.doc_id: r.text for r in one.collect()}
    least, _ = jaccard_classes(kept)
    assert {r.doc_id for r in two.collect()} == {d for d, m in least.items() if d == m}
    three = stages["secret_scan"](spark, two, "").cache()
    marked = 0
    for r in three.collect():
        text, done, out = kept[r.doc_id], 0, []
        for span in filter(None, base(text).split(",")):
            _, begin, end = span.split(":")
            if int(begin) >= done:
                out += [text[done : int(begin)], "[SECRET]"]
            done = max(done, int(end))
        marked += bool(out)
        assert r.text == "".join([*out, text[done:]]) and r.n_chars == len(r.text)  # these texts have base secrets only
    four = stages["source_mix"](spark, three, "").cache()
    size = lambda text: len(re.findall(mix_schedule.WORD, text or ""))
    held = {}
    for r in three.collect():
        held[r.source] = held.get(r.source, 0) + size(r.text)
    mixed = four.collect()
    for t in mix_schedule.targets(list(held.items())):
        assert sum(size(r.text) for r in mixed if r.source == t.source) == t.quota
    library = sentencepiece.SentencePieceProcessor(model_file=piece_stream.default_path())
    five = stages["sentencepiece"](spark, four, "").collect()
    assert sorted((r.doc_id, r.ids) for r in five) == sorted((r.doc_id, library.encode(r.text)) for r in mixed)


def test_pipeline_on_small_documents(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids", "n_ids"] and out.count() > 100
