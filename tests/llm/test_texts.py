"""Token counts, packing, mixing, language and toxicity on small and awkward documents."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stakeflow.llm import langid, mixing, packing, queries, tokens, toxicity

from ..conftest import SF
from .cases import MORE, awkward, empty, frame, prose, rows, words


def test_token_counts_match_a_plain_unigram_search(spark):
    from tokenizers import models

    scores, unknown = tokens.piece_scores(tokens.vocabulary_path())
    plain = models.Unigram([("<unk>", 0.0), *scores.items()], 0, False)
    got = {(r.doc_id, r.n_words): r.n_tokens for r in tokens.token_counts(frame(spark, awkward())).collect()}
    for doc, text, *_ in awkward():
        if text is None or text.isascii():
            own = (text or "").split()
            assert got[doc, len(own)] == sum(len(plain.tokenize(tokens.MARK + w)) for w in own)
    assert tokens.token_counts(empty(spark)).count() == 0


def plain_count(word, scores, unknown, longest):
    """Tokens of the best segmentation of one word, by a search over its places."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + unknown, best[end - 1][1] + 1)]
        options += [(best[at][0] + scores[word[at:end]], best[at][1] + 1) for at in range(max(0, end - longest), end) if word[at:end] in scores]
        best[end] = max(options, key=lambda o: (round(o[0], 9), -o[1]))
    return best[-1][1]


def test_token_counts_beyond_ascii(spark):
    scores, unknown = tokens.piece_scores(tokens.vocabulary_path())
    longest = max(map(len, scores))
    texts = ["é中 \U0001f600 ́x", "Straße über größe", "naïve café déjà-vu", "Привет мир", "mañana\u00a0señor ción", "日本語 テキスト", "a\u0301 e\u0301"]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.token_counts(frame(spark, rows(list(enumerate(texts))))).collect()}
    for i, text in enumerate(texts):
        own = text.encode().split()
        assert got[i] == (len(own), sum(plain_count(tokens.MARK + w.decode(), scores, unknown, longest) for w in own)), text


def test_shared_prefixes_give_the_counts_of_single_words():
    r = random.Random(4)
    vocab = {"a": -1.0, "ab": -1.2, "b": -2.0, "abc": -3.0, "c": -1.5, "ca": -2.5}
    every = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(300)})
    trie = tokens.UnigramTrie(vocab, -9.0)
    assert trie.counts(every) == [tokens.UnigramTrie(vocab, -9.0).counts([w])[0] for w in every]

    def best(w):
        """(score, tokens) of all segmentations of w, tried one by one."""
        if not w:
            return 0.0, 0
        options = [(1, -9.0)] + [(n, vocab[w[:n]]) for n in range(1, 4) if w[:n] in vocab and len(w) >= n]
        tried = [(score + best(w[n:])[0], -1 - best(w[n:])[1]) for n, score in options]
        top = max(tried, key=lambda t: (round(t[0], 9), t[1]))
        return top[0], -top[1]

    assert [best(w)[1] for w in every[:60]] == trie.counts(every[:60])


def test_packing_round_trip(spark):
    import array

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    data = awkward() + [(20, "odd <|endoftext|> it's ΣΑΣ café ² x y  z", *awkward()[0][2:])]
    pieces = packing.pack_documents(frame(spark, data)).collect()
    want = Counter()
    for doc, text, *_ in data:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, n, at, len(part), zlib.crc32(array.array("I", part).tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(p.length for p in pieces) / 2048) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


def test_sum_of_squares_choice_is_the_smallest():
    sizes = np.random.default_rng(0).integers(1, 60, 400)
    bins, offsets = packing.place_pieces(sizes, 64)
    gap, order = {}, np.argsort(-sizes, kind="stable")
    for i in order.tolist():
        s, count = int(sizes[i]), Counter(g for g in gap.values() if g)

        def cost(g):
            c = count.copy()
            c[g] -= 1
            if g > s:
                c[g - s] += 1
            return sum(v * v for v in c.values())

        fits = {g for g in gap.values() if g >= s}
        b = int(bins[i])
        assert (b in gap) == bool(fits)
        if fits:
            assert cost(gap[b]) == min(map(cost, fits))
        gap[b] = gap.get(b, 64) - s
        assert offsets[i] + s + gap[b] == 64


def test_mix_matches_sql_on_awkward_sources(spark):
    data = [(i, prose(i, i % 37), "en", src, 0, *MORE) for i, src in enumerate(["a", "b", None, "Z", "é", "a", ""] * 30)]
    docs = frame(spark, data + data[:3])
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.MIX_SQL})").fetchall())
    plan = mixing.mix_sources(docs)
    got = sorted(tuple(r) for r in plan.select(*cols).collect())
    assert got == want
    rows = plan.collect()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6
    finish = [r.virtual_finish for r in rows if r.virtual_finish is not None]
    assert finish == sorted(finish)


def test_mixed_documents_keep_columns_and_whole_texts(spark):
    docs = frame(spark, awkward())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in out.collect()} <= texts
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.lang}
    out = [got[d].lang_pred == v for d, v in true.items() if got[d].held_out]
    assert len(out) > 20 and sum(out) >= 0.95 * len(out)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)


def test_language_of_awkward_documents(spark):
    rows = langid.identify_language(frame(spark, awkward())).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        text = next(t for d, t, *_ in awkward() if d == r.doc_id)
        assert 0 <= r.score <= 1
        if r.doc_id in (5, 6, 7):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and text:
            assert r.lang_pred == "en"
    assert langid.identify_language(empty(spark)).count() == 0
    none = frame(spark, awkward()).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_language(none).collect()} == {"und"}


def plain_features(text):
    """Hashed n-gram counts of one text, byte by byte."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode("utf-8", "replace")]
    data = [b for i, b in enumerate(data) if b != 32 or i == 0 or data[i - 1] != 32]
    total = Counter()
    for order in langid.ORDERS:
        for i in range(len(data) - order + 1):
            code = 0
            for b in data[i : i + order]:
                code = (code * 257 + b) % 2**32
            total[((code + order) * 2654435761 % 2**32) >> 20] += 1
    norm = math.sqrt(sum(total.values()))
    return {b: math.sqrt(n) / norm for b, n in total.items()}


def test_language_equals_plain_decoding(spark):
    """Features, margins and losses of every document by loops, with the classifiers that the operator fits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_language(docs).collect()}
    for r in docs.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        x = plain_features(r.text)
        losses = []
        for code in model.code:
            loss = 0.0
            for bit, sign in enumerate(code):
                margin = model.bias[bit] + sum(v * model.weights[b, bit] for b, v in x.items())
                loss += model.bit_weight[bit] * math.log1p(math.exp(-margin * sign))
            losses.append(loss)
        best = min(range(len(losses)), key=losses.__getitem__)
        score = 1 / sum(math.exp(losses[best] - v) for v in losses)
        assert got[r.doc_id][0] == model.languages[best] and got[r.doc_id][1] == pytest.approx(score, abs=1e-4)


def test_codewords_differ():
    for n in (1, 2, 4, 9):
        code = langid.codewords(n)
        assert len(code) == n
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))


def _examples(n=120, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        toxic = int(i % 4 == 0)
        tf = Counter({r.randrange(0, 12) + (8 if toxic else 0): r.randint(1, 4) for _ in range(r.randint(1, 6))})
        out.append((i, toxic, dict(tf)))
    return out


def test_block_max_search_is_exact():
    index = toxicity.build_index([f"t{i}" for i in range(20)], _examples(400), 0.25)
    dense = np.zeros((len(index.ids), 20))
    for t in range(20):
        lo, hi = index.starts[t, 0], index.starts[t, -1]
        dense[index.posting_example[lo:hi], t] = index.posting_weight[lo:hi]
    assert np.allclose((dense**2).sum(1), 1)
    for _, _, tf in _examples(60, 9):
        term, weight = index.vector(tf)
        at, cosine = index.nearest(term, weight, 15)
        every = dense[:, term] @ weight
        best = np.sort(every)[::-1][:15]
        assert np.allclose(cosine, best[best > 0][: len(cosine)])
        assert np.allclose(every[at], cosine)


def test_search_over_all_terms_is_exact():
    r = random.Random(3)
    # four groups with their own common terms, and rare terms that any example may hold
    docs = [Counter([f"c{i % 4}-{r.randrange(6)}" for _ in range(12)] + [f"r{int(r.paretovariate(0.5)) % 500}" for _ in range(r.randint(1, 9))])
            for i in range(900)]
    terms = sorted({t for d in docs for t in d})
    cells = [(n, terms.index(t), c) for n, d in enumerate(docs) for t, c in d.items()]
    example, term, count = (np.array(v) for v in zip(*cells))
    index = toxicity.Vectors(np.arange(900), np.arange(900) % 7 == 0, terms, example, term, count)
    assert 0 < index.common < len(terms)
    idf = {t: math.log(901 / (1 + sum(t in d for d in docs))) + 1 for t in terms}

    def unit(tf):
        raw = {t: (1 + math.log(c)) * idf[t] for t, c in tf.items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / size for t, v in raw.items()}

    units = [unit(d) for d in docs]
    queries = [{index.terms[t]: c for t, c in d.items()} for d in docs[:60]]
    got = index.nearest(queries, 20)
    alone = index.nearest(queries, 20, [index.ids.tolist().index(n) for n in range(60)])
    for n in range(60):
        every = np.array([sum(v * units[e].get(t, 0) for t, v in units[n].items()) for e in index.ids.tolist()])
        at, cosine = got[n]
        assert np.allclose(cosine, np.sort(every)[::-1][:20]) and np.allclose(every[at], cosine)
        assert n not in index.ids[alone[n][0]]


def test_terms_of_texts_are_counted_together():
    texts = ["Kate katexxx, (kate) x-y", None, "", "unknown katexxx é́a 12", "x " * 70]
    names = ["kate", "kate*", "katex*", "katexxx", "x", "y", "é́a"]
    scorer = toxicity.Scorer(0.5)
    scorer.wide = type("Terms", (), {"terms": {t: n for n, t in enumerate(names)}})
    scorer.telling = type("Terms", (), {"terms": {"katexxx": 0}})
    words = toxicity.WordTerms(scorer)
    for _ in range(2):  # the second time from the words kept
        wide, telling = words.counts(texts)
        for text, (term, count), (t, c) in zip(texts, wide, telling):
            want = Counter(names.index(x) for w in (text or "").split() for x in toxicity.word_terms(w) if x in names)
            assert dict(zip(term.tolist(), count.tolist())) == want and term.tolist() == sorted(want)
            assert dict(zip(t.tolist(), c.tolist())) == ({0: 1} if "katexxx" in (text or "") else {})
    plain = [r for w in ("(Émile's)", "a.b", "..", "İx", "é́a") for r in toxicity.LETTERS.findall(w.lower())]
    assert [r for w in ("(Émile's)", "a.b", "..", "İx", "é́a") for r in toxicity.word_terms(w) if "*" not in r] == plain


def test_words_without_a_known_term_keep_nothing():
    scorer = toxicity.Scorer(0.5)
    scorer.wide = type("Terms", (), {"terms": {"kate": 0, "kate*": 1, "kates*": 2}})
    scorer.telling = type("Terms", (), {"terms": {"lovel*": 0}})
    words = toxicity.WordTerms(scorer)
    wide, telling = words.counts(["one two three", "katesxx lovelxx kate"])
    assert words["one"] == words["three"] != words["kate"] and len(words.ends[0]) == 5
    assert not len(wide[0][0]) and wide[1][0].tolist() == [0, 1, 2] and wide[1][1].tolist() == [1, 1, 1]
    assert telling[1][0].tolist() == [0] and not len(telling[0][0])


def test_every_text_with_a_known_word_has_evidence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id for r in labels.collect() if r.toxic is not None}
    learned = set()
    for r in docs.collect():
        if r.doc_id in known and zlib.crc32(str(r.doc_id).encode()) % 5:
            learned.update(t for w in (r.text or "").split() for t in toxicity.word_terms(w))
    got = {r.doc_id: r.evidence for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        assert bool(got[r.doc_id]) == any(t in learned for w in (r.text or "").split() for t in toxicity.word_terms(w))


def test_toxicity_on_small_tables(spark):
    bad = ["trash", "scum", "idiot"]
    data, labels = [], []
    for i in range(400):
        text = prose(i, 40)
        if i % 5 == 0:
            text += " " + " ".join(bad)
        data.append((i, text, "en", "s", 0, *MORE))
        if i < 300:
            labels.append((i, int(i % 5 == 0), 1))
    docs = frame(spark, data + awkward())
    known = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (4, 0, 0)], "doc_id long, toxic int, quality int")
    got = [r for r in toxicity.score_toxicity(docs, known).collect()]
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 20}
    assert all(by[i].predicted == int(i % 5 == 0) for i in by)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if (r.doc_id or 0) >= 20} == {i for i in range(20, 400) if i % 5}
    assert toxicity.score_toxicity(empty(spark), known).count() == 0
    none = toxicity.score_toxicity(docs, known.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_toxicity_of_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    score = {r.doc_id: r for r in queries.op3_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if score[r.doc_id].held_out]
    bad, good = [score[d].score for d, y in labels if y], [score[d].score for d, y in labels if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.96
    assert np.mean([score[d].predicted == y for d, y in labels]) > 0.97
    assert np.mean([score[d].predicted for d, y in labels if y]) > 0.9
    assert np.mean([score[d].predicted for d, y in labels if not y]) < 0.02


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    got = sorted((tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, SF).collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)


def test_words_helper_matches_pattern():
    import pyarrow as pa

    from stakeflow.llm.words import split_words

    texts = [t for _, t, *_ in awkward()]
    got = split_words(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        own = words(text)
        assert len(got.of(i)) == len(own)
        for h, w in zip(got.of(i).tolist(), own):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)
