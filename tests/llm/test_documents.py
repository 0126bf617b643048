"""The operators on documents against brute force, with nulls, ties, copies, long and empty texts."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream.llm import importance, language_profiles, minhash, sentencepieces, token_lengths
from quillstream.llm.decontaminate import Benchmark, LeakConfig, find_leaks, own_statistics, without_leaks
from quillstream.llm.deleted_interpolation import InterpolationConfig, fit_weights, score_documents
from quillstream.llm.sentencepieces import decode_documents, encode_digests, encode_documents
from quillstream.llm.tokens import LETTER_CLASSES, token_hashes


def lowered(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingle_set(text, n):
    w = lowered(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def expected_components(rows, n, percent):
    ids = [r[0] for r in rows if r[0] is not None]
    sets = {r[0]: shingle_set(r[1], n) for r in rows if r[0] is not None}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in keys}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("config", [minhash.MinMaxConfig(), minhash.MinMaxConfig(shingle=5, percent=80, bands=30, rows=5, block=4), minhash.MinMaxConfig(mass=64), minhash.MinMaxConfig(block=2, pivots=1, percent=60, slack=40, bands=60, rows=2)])
def test_near_duplicates_match_brute_force(clashing, corpus_rows, config):
    component, size = expected_components(corpus_rows, config.shingle, config.percent)
    out = minhash.near_duplicates(clashing, config).collect()
    assert len(out) == len(corpus_rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (component[r.doc_id], size[r.doc_id], component[r.doc_id] == r.doc_id)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (5, b), (7, a + " more"), (9, b + " more"), (8, "c d e f"), (11, ""), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(0))
    out = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert out == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 1, False), (8, 8, True), (9, 5, False), (11, 11, True)]
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b), (8, "c d e f"), (11, "")]


def test_clusters_of_several_blocks_lose_no_link(spark):
    import random

    rng = random.Random(9)
    rows = []
    for _ in range(4):  # chains: each text is like the last one, and the ends are not alike
        w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(20):
            rows.append((len(rows), " ".join(w)))
            w = [*w[1:], f"w{rng.randrange(10**6)}"]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    component, _ = expected_components(rows, 3, 85)
    assert len(set(component.values())) == 4
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, minhash.MinMaxConfig(block=5, pivots=2)).collect()}
    assert got == component


def test_one_of_each_group_stays_with_all_columns(docs, corpus_rows):
    kept = minhash.keep_one_of_each(docs, minhash.MinMaxConfig())
    component, _ = expected_components(corpus_rows, 3, 85)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in component.items() if i == c) and ids.count(None) == 1


def test_language_model_counts_and_base(clashing, corpus_rows):
    config = InterpolationConfig(chunk=700, key_range=500)
    out = score_documents(clashing, config).collect()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    tokens = [[*lowered(r[1]), None] for r in corpus_rows]
    counts = collections.Counter(t for r, ts in zip(corpus_rows, tokens) if not held(r[0]) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), held(r[0]), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for r, ts in zip(corpus_rows, tokens))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want and all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_language_model_scores_by_its_formula(spark):
    rows = [(k, ["a b a b c", "b c a", "a b c d"][k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(df).collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 10

    def tables(keep):
        uni, bi = collections.Counter(), collections.Counter()
        for d, t in rows:
            if keep(fold(d)):
                ts = ["<", *t.split(), ">"]
                uni.update(ts)
                bi.update(zip(ts, ts[1:]))
        return uni, bi, sum(c for t, c in uni.items() if t != "<"), len(uni) - 1

    bucket = lambda c: min(int(math.log2(c)) + 1, 47) if c else 0
    uni, bi, n, v = tables(lambda f: f not in (0, 9))
    cells, step = collections.Counter(), lambda p: 2.0 ** (round(4 * math.log2(p * (v + 1))) / 4) if p else 0.0
    for d, t in rows:
        if fold(d) == 9:
            ts = ["<", *t.split(), ">"]
            for a, b in zip(ts, ts[1:]):
                cells[bucket(uni[a]), step(bi[a, b] / uni[a]) if uni[a] else 0.0, step(uni[b] / n)] += 1
    weights = fit_weights([(*k, c) for k, c in cells.items()], 60)
    uni, bi, n, v = tables(lambda f: f != 0)
    for d, t in rows:
        ts = ["<", *t.split(), ">"]
        want = 0.0
        for a, b in zip(ts, ts[1:]):
            w = weights[bucket(uni[a])]
            want += math.log10(w[0] * bi[a, b] / uni[a] + w[1] * uni[b] / n + w[2] / (v + 1))
        assert got[d] == pytest.approx(want, abs=1e-9)


def test_weights_sum_to_one_and_spare_the_unseen():
    w = fit_weights([(3, 8.0, 2.0, 50), (3, 0.0, 0.0, 5), (0, 0.0, 4.0, 9)], 40)
    assert w.sum(axis=1) == pytest.approx([1] * len(w)) and (w[:, 2] > 0).all() and w[0, 0] == 0
    assert w[3, 0] > w[3, 1]


def test_language_profiles_are_rank_orders(clashing, corpus_rows, spark):
    profiles = language_profiles.learn_profiles(clashing)
    assert profiles.names == ["de", "en"]

    def grams(text):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            p = f" {w} "
            out.update(w)
            out.update(p[i : i + 2] for i in range(len(p) - 1))
            out.update(p[i : i + 3] for i in range(len(p) - 2))
        return out

    keys, counts = language_profiles.ngram_counts("Ab, ba! aé")
    assert counts.sum() == sum(grams("Ab, ba! aé").values()) and len(keys) == len(grams("Ab, ba! aé"))
    out = language_profiles.identify_languages(clashing).collect()
    assert len(out) == len(corpus_rows) and all(0 <= r.score <= 1 for r in out)
    blank = {160, 161, 162}
    assert all((r.lang_pred == "und") == (r.doc_id in blank) for r in out)
    text = [("der hund und die katze", "de"), ("the dog and the cat", "en")] * 20
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(text)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == text[r.doc_id][1] for r in language_profiles.identify_languages(df).collect())


def test_out_of_place_distance_by_hand():
    p = language_profiles.Profiles.of({"x": [5, 6, 7], "y": [7, 6, 8]}, 3)
    import numpy as np

    assert p.ranks[0].tolist() == [0, 1, 2, -1] and p.grams.tolist() == [5, 6, 7, 8] and np.all(p.ranks[1] == [-1, 1, 0, 2])


def test_language_judge_matches_brute_force():
    import random

    rng = random.Random(4)
    alphabet = {"x": "abcdef", "y": "defghi", "z": "aeiouß"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(n))

    def grams(t):
        out = collections.Counter()
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f" {w} "
            for n, s in ((1, w), (2, p), (3, p)):
                out.update(s[i : i + n] for i in range(len(s) - n + 1))
        return out

    def order(counts, size):  # most frequent first; ties by length, then by code points
        return sorted(counts, key=lambda g: (-counts[g], len(g), [ord(c) for c in g]))[:size]

    size, train = 40, {lang: text(lang, 300) for lang in alphabet}
    pack = lambda g: int.from_bytes((sum(ord(c) << 20 * (len(g) - 1 - i) for i, c in enumerate(g)) | len(g) << 60).to_bytes(8, "big"), "big", signed=True)
    listed = {lang: order(grams(t), size) for lang, t in train.items()}
    profiles = language_profiles.Profiles.of({lang: [pack(g) for g in gs] for lang, gs in listed.items()}, size)
    for k in range(60):
        t = text("xyz"[k % 3], rng.randrange(1, 40))
        own = order(grams(t), size)
        away = {lang: sum(min(abs(gs.index(g) - i), size) if g in gs else size for i, g in enumerate(own)) for lang, gs in listed.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        assert profiles.judge(t) == (best, pytest.approx(1 - away[best] / (size * len(own))))


def test_documents_with_a_language_keep_their_columns(clashing, corpus_rows):
    profiles = language_profiles.learn_profiles(clashing)
    kept = language_profiles.with_language(clashing, profiles, 0.0)
    assert kept.columns == clashing.columns and kept.count() == len(corpus_rows) - 3 and {r.score for r in kept.collect()} == {"z"}


def test_length_histogram_answers_every_limit(clashing, corpus_rows):
    encode = token_lengths.tiktoken_encoder("byte_bpe_50k.tiktoken").encode_ordinary
    sizes = [len(encode(r[1] or "")) for r in corpus_rows]
    got = {r.n_tokens: r for r in token_lengths.length_histogram(clashing).collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        longer = [s for s in sizes if s >= n]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(n), len(longer), sum(longer))
        assert r.truncated_total == sum(min(s, n) for s in sizes) and r.total_tokens == sum(sizes)
        assert r.share_at_most == pytest.approx(sum(s <= n for s in sizes) / len(sizes))
    report = token_lengths.context_report(token_lengths.length_histogram(clashing), [64, 4096])
    assert {r.context: r.truncated_total for r in report.collect()} == {c: sum(min(s, c) for s in sizes) for c in (64, 4096)}


def test_sentencepieces_equal_the_library(clashing, corpus_rows, spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    hard = ["  x  y ", "日本語 <s> </s> <0x0A>\n\tab", "a" * 300 + "the" * 90, " ", "\n", "é" * 70 + "####" * 30, "😀😀 x", "a    b" * 9, "naïve café — déjà vu", "ﬁ ½ Ⅷ"]
    rows = [*corpus_rows, *((900 + k, t, "en", "s", 0) for k, t in enumerate(hard))]
    df = spark.createDataFrame(rows, clashing.schema.fieldNames()[0] + " long, text string, lang string, source string, n_chars long").withColumn("tokens", F.lit(1))
    encoded = encode_documents(df)
    want = {(r[0], r[1]): library.encode(r[1] or "") for r in rows}
    for r in encoded.collect():
        assert list(r.tokens) == want[r.doc_id, r.text]
    assert all(r.decoded == (r.text or "") for r in decode_documents(encoded).collect())
    digests = encode_digests(clashing).collect()
    assert len(digests) == len(corpus_rows) and all(r.round_trip for r in digests)
    by_id = collections.defaultdict(list)
    for r in corpus_rows:
        by_id[r[0]].append(library.encode(r[1] or ""))
    assert all(list(r.tokens) in by_id[r.doc_id] and r.n_tokens == len(r.tokens) for r in digests)


def test_sentencepieces_in_small_parts_and_with_names_that_clash(monkeypatch):
    import random

    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 30))) for _ in range(200)) for _ in range(6)] + ["a  " * 50, "x" * 400, None, "", " ", "end"]
    want = [library.encode(t or "") for t in texts]

    def check(model):
        for _ in range(2):
            ids, ptr = sentencepieces.encode_batch(texts, model)
            assert [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == want

    load = lambda: sentencepieces.PieceModel.load("piece_bpe_32k.model")
    check(load())
    monkeypatch.setattr(sentencepieces, "_PIECE", 64)
    monkeypatch.setattr(sentencepieces, "_GROUP", 32)
    check(load())
    small = load()
    small.memo_bytes = 2000
    check(small)
    memo = small.memo
    assert 0 < 40 * len(memo.names) + 4 * len(memo.ids) + 4 * len(memo.points) <= 2000
    names = sentencepieces._segment_hashes
    monkeypatch.setattr(sentencepieces, "_segment_hashes", lambda *x: names(*x) % 7)
    check(load())


def test_a_model_of_long_pieces_is_refused():
    with pytest.raises(ValueError):
        sentencepieces.PieceModel({"x" * 64: 0}, [0], [0] * 256, 0, False, [b""])


def item_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_leaks_match_brute_force(clashing, corpus_rows, spark):
    items = [(1, corpus_rows[5][1]), (2, "zz yy xx ww vv uu tt ss rr qq"), (3, None), (4, ""), (5, corpus_rows[8][1].upper() + "!!"), (6, "single"), (7, corpus_rows[166][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(0))
    extra = spark.createDataFrame([(500, "start " + items[1][1].replace(" ", ", ") + " end", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    data = clashing.select(extra.columns).unionByName(extra)

    def part_found(part, doc):
        n = min(5, len(part))
        runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return not part or len(runs(part) & runs(doc)) >= 0.8 * len(runs(part))

    want = set()
    for d, t, *_ in [*corpus_rows, *extra.collect()]:
        for i, item in items:
            w = item_words(item)
            cut = (len(w) + 1) // 2
            if w and item_words(t) and part_found(w[:cut], item_words(t)) and part_found(w[cut:], item_words(t)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in find_leaks(data, bench).collect()}
    assert got == want and (500, 2) in got
    scores = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in find_leaks(data, bench).collect()}
    for config in (LeakConfig(max_items=1), LeakConfig(max_items=2, block=2, at_once=2), LeakConfig(half=4)):
        again = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in find_leaks(data, bench, config).collect()}
        assert set(again) == want
        if config.half == 64:
            assert all(again[k] == pytest.approx(scores[k]) for k in want)
    kept = without_leaks(data, bench)
    assert kept.columns == data.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in data.collect()} - {d for d, _ in want}


@pytest.mark.parametrize("config", [LeakConfig(half=8, block=2, at_once=3), LeakConfig(half=8, block=3, at_once=1, threshold=0.2), LeakConfig(half=8, block=1)])
def test_pivots_retrieve_what_scoring_every_item_does(config):
    rng = np.random.default_rng(5)
    draw = lambda n: [f"w{x}" for x in np.minimum(rng.zipf(1.3, n), 60)]
    items = [draw(int(rng.integers(1, 9))) for _ in range(30)]
    texts = [draw(int(rng.integers(0, 60))) for _ in range(40)] + [[], ["unknown"], items[3], draw(3) + items[7] + draw(3)]
    lines = [" ".join(t) for t in items]
    stats = own_statistics(lines)
    (index,) = Benchmark(list(enumerate(lines)), config, stats).indexes
    hashes, ptr = token_hashes(pa.array([" ".join(t) for t in texts], pa.large_string()), LETTER_CLASSES)
    got = {(r, index.ids[i]): s for (r, i), s in index.search(hashes, ptr).items()}

    df = {w: sum(w in t for t in items) for t in items for w in t}
    want = {}
    for i, item in enumerate(items):
        weight = {}
        for w in set(item):
            tf, norm = item.count(w), config.k1 * (1 - config.b + config.b * len(item) / stats.mean)
            weight[w] = math.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (config.k1 + 1) / (tf + norm)
        for r, text in enumerate(texts):
            for at in range(0, len(text), config.half):
                score = sum(x for w, x in weight.items() if w in text[at : at + 2 * config.half]) / sum(weight.values())
                if score >= config.threshold:
                    want[r, i] = max(want.get((r, i), 0.0), score)
    assert got == pytest.approx(want) and len(want) > 30


def foul_corpus(n=600, seed=3):
    """Rows and labels; every fourth document is foul by one word, every fourth is junk in its punctuation."""
    import random

    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = [f"w{rng.randrange(200)}" for _ in range(60)]
        kind = k % 4
        if kind == 1:
            w[rng.randrange(60)] = rng.choice(["slur", "filth"])
        elif kind == 2:
            w = [x + "***" for x in w]
        elif kind == 3 and k % 8 == 3:
            w = ["again"] * 60
        rows.append((k, " ".join(w)))
        if k % 5:
            labels.append((k, 0 if kind == 2 or kind == 3 and k % 8 == 3 else 1, int(kind == 1)))
    return rows, labels, {k for k in range(n) if k % 4 in (1, 2) or k % 8 == 3}


def test_importance_keeps_clean_and_drops_foul(spark):
    rows, labels, foul = foul_corpus()
    rows += [(1000, None), (1001, ""), (None, "w1 w2 w3"), (1002, "w1 w2"), (1002, "w1 w2"), (1003, "w1 w2 w3 " * 5000)]
    labels += [(2000, 1, 0), (1, None, None), (None, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "good", "weight", "selected", "ratio")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(0))
    out = importance.resample(df, lab).collect()
    assert len(out) == len(rows)
    clean_lost = [r.doc_id for r in out if r.doc_id is not None and r.doc_id < 600 and r.doc_id not in foul and not r.selected]
    foul_kept = [r.doc_id for r in out if r.doc_id in foul and r.selected]
    known = [r for r in out if r.doc_id is not None and r.doc_id < 600]
    worst_clean, best_foul = min(r.weight for r in known if r.doc_id not in foul), max(r.weight for r in known if r.doc_id in foul)
    assert worst_clean > best_foul + 3  # the weights part them; the draw is random and swaps some
    assert len(clean_lost) <= 0.1 * 225 and len(foul_kept) <= 0.1 * 375, (clean_lost, foul_kept)
    assert all(r.weight == max(x.weight for x in out) for r in out if r.doc_id is None or r.doc_id >= 1000)
    again = {(r.doc_id, r.draw_key) for r in importance.resample(df, lab).collect()}
    assert again == {(r.doc_id, r.draw_key) for r in out}
    kept = importance.select_documents(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.selected for r in out)


def test_importance_weights_and_draw_by_brute_force(spark):
    import random

    rng, rows, labels = random.Random(8), [], []
    for k in range(300):  # shady words stand in both kinds, in the bad more often
        w = [f"w{rng.randrange(50)}" for _ in range(30)] + [f"s{j}" for j in range(12) if rng.random() < (0.4 if k % 3 == 0 else 0.06)]
        rng.shuffle(w)
        rows.append((k, " ".join(w)))
        if k % 4:
            labels.append((k, int(k % 6 != 0), int(k % 6 == 3)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    config = importance.ImportanceConfig(k=150, apart=2.0, pairs_apart=2.5, least_ratio=0.5, smoothing=0.5)
    got = {r.doc_id: r for r in importance.resample(df, lab, config).collect()}

    def grams(text):
        tokens, out, before, run = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^\sA-Za-z0-9\x80-\U0010ffff]+", text.lower()), [], None, 0
        for k, t in enumerate(tokens):
            run = min(run + 1, 12) if k and t == tokens[k - 1] else 0
            out.append(("again", run) if run else t)
        return {(x,) for x in out} | {(a, b) for a, b in zip([None, *out], out)}

    held = {d: grams(t) for d, t in rows}
    good = {d for d, q, x in labels if q == 1 and x == 0}
    bad = {d for d, q, x in labels} - good
    count = lambda ids: collections.Counter(g for d in ids for g in held[d])
    n_raw, n_good, n_bad = count(held), count(good), count(bad)
    share, n = len(good) / (len(good) + len(bad)), len(rows)
    ratio = {}
    for g in n_raw:
        known = n_good[g] + n_bad[g]
        target = n_good[g] * share * n / len(good)
        apart = (n_bad[g] - known * (1 - share)) / math.sqrt(max(known * share * (1 - share), 1e-9))
        if n_bad[g] >= 5 and apart >= (2.0 if len(g) == 1 else 2.5):
            value = math.log((target + 0.5 * share) / (max(n_raw[g] - target, 0) + 0.5 * (1 - share)) / (share / (1 - share)))
            if value <= -0.5:
                ratio[g] = value
    r = {d: max(sum(ratio.get(g, 0) for g in gs), -200) for d, gs in held.items()}
    post = lambda x, prior: 1 / (1 + math.exp(min(700, -(x + prior))))
    low, high = -500.0, 500.0
    for _ in range(100):
        prior = (low + high) / 2
        low, high = (prior, high) if sum(post(r[d], prior) for d in good | bad) < len(good) else (low, prior)
    assert any(v < 0 for v in ratio.values()) and len(set(r.values())) > 20
    for d in held:
        assert got[d].weight == pytest.approx(math.log(post(r[d], prior) / share), abs=0.02)
    keys = sorted((x.draw_key for x in got.values()), reverse=True)
    assert {d for d, x in got.items() if x.selected} == {d for d, x in got.items() if x.draw_key >= keys[149]} and sum(x.selected for x in got.values()) == 150
    noise = [x.draw_key - x.weight for x in got.values()]
    assert abs(sum(noise) / n - 0.5772) < 0.25 and min(noise) < -1 and max(noise) > 3
    plain = sorted(got, key=lambda d: -got[d].weight)[:150]
    assert set(plain) != {d for d, x in got.items() if x.selected}


def test_rare_words_of_bad_documents_do_not_drop_long_clean_ones(spark):
    import random

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    rows, labels = [], []
    for k in range(300):
        w = words(60)
        if k % 3 == 0:  # foul by one word, and each holds four words that no other does
            w[10:14] = [f"r{k}x{j}" for j in range(4)]
            w[rng.randrange(20, 60)] = rng.choice(["slur", "filth"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 3 == 0)))
    for k in range(300, 360):
        w = words(3000)
        w[1000:1004] = [f"r{3 * (k - 300)}x{j}" for j in range(4)]
        if k % 2:
            w[2000] = "slur"
        rows.append((k, " ".join(w)))
    out = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    lost = [r.doc_id for r in out if r.doc_id >= 300 and r.doc_id % 2 == 0 and not r.selected]
    kept = [r.doc_id for r in out if r.doc_id >= 300 and r.doc_id % 2 and r.selected]
    weights = {r.doc_id: r.weight for r in out if r.doc_id >= 300}
    assert min(w for d, w in weights.items() if d % 2 == 0) > max(w for d, w in weights.items() if d % 2) + 3
    assert len(lost) <= 5 and len(kept) <= 5, (lost, kept)


def test_kth_largest_is_exact(spark):
    values = [1.5, 1.5, -2.0, 7.25, 7.25, 7.25, 1e9, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one_of_each(empty).count() == 0
    assert score_documents(empty).count() == 0
    assert language_profiles.identify_languages(empty).count() == 0
    assert token_lengths.length_histogram(empty).count() == 0
    assert encode_digests(empty).count() == 0 and encode_documents(empty).count() == 0
    assert importance.resample(empty, labels).count() == 0
    assert find_leaks(empty, bench).count() == 0 and without_leaks(empty, bench).count() == 0


def test_no_labels_and_no_items_keep_everything(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs, labels).where("selected").count() == docs.count()
    assert without_leaks(docs, bench).count() == docs.count() and find_leaks(docs, bench).count() == 0
