"""Operators that treat documents one by one, held against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from pyspark.sql import functions as F

from tarn.llm import decontamination, exact_dedup, language_id, license_scan, lm_scoring, sentencepiece_codec, token_counts, token_output

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


# exact dedup


def test_exact_dedup(docs, rows):
    norm = {}
    for d, t, *_ in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    want = []
    for d, t, *_ in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(norm[n])[1]
        want.append((d, keep, len(norm[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert by_row(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_index_persists(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, second = frame((1, "a b"), (2, "c")), frame((3, "a  b"), (4, "new"))
    exact_dedup.exact_dedup(first, exact_dedup.DigestIndex(spark, place, 4, first=True)).collect()
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        exact_dedup.DigestIndex(spark, place, 8)
    with pytest.raises(ValueError, match="no index"):
        exact_dedup.DigestIndex(spark, f"{place}-none")
    index = exact_dedup.DigestIndex(spark, place, first=True)
    for n in (2, 3, 4):  # a caller's index stays open, and each use counts
        assert by_row(exact_dedup.exact_dedup(second, index), "doc_id", "keep_id", "group_size", "kept") == [(3, 1, n, False), (4, 4, n - 1, True)]
    index.close()
    assert spark.read.parquet(f"{place}/keepers").count() == 3
    best = exact_dedup.DigestIndex(spark, place)
    assert by_row(exact_dedup.exact_dedup(frame((5, " a b"), (0, "c")), best), "doc_id", "keep_id", "group_size") == [(0, 0, 2), (5, 5, 5)]
    best.close()


@pytest.mark.parametrize("batches", [2, 5])
def test_batches_give_what_one_gives(docs, batches):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert by_row(exact_dedup.exact_dedup(docs, batches=batches), *columns) == by_row(exact_dedup.exact_dedup(docs), *columns)


def test_index_is_read_in_its_buckets(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    index.add(exact_dedup.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string")))
    new = spark.createDataFrame([(bytearray(b"x"),)], "digest binary")
    plan = new.join(index.frame().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    index.close()


# tokens


def test_whole_tokens_are_proved(library):
    whole = token_counts.whole_tokens(WORD_BPE)
    assert len(whole) > 30_000
    for w in list(whole)[::997]:
        assert library(w.decode()) == [whole[w]]


def test_token_counts(docs, rows, library):
    got = by_row(token_counts.token_counts(docs, WORD_BPE, 100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), len(library(t)), len(library(t)) > 100) for d, t, *_ in rows]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_file(docs, rows, file):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    tok = Tokenizer.from_file(path)
    more = "a  b\n c <|endoftext|> x\u00a0y\u2028z It's"
    extra = docs.select("doc_id", "text").limit(1).selectExpr("cast(9000 as long) doc_id", f"'{more.replace(chr(39), chr(92) + chr(39))}' text")
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    got = by_row(token_counts.token_counts(docs.select("doc_id", "text").unionByName(extra), path), "doc_id", "n_tokens")
    assert got == sorted([*((d, n(t)) for d, t, *_ in rows), (9000, n(more))], key=repr)
    ids = {r.doc_id: r.n_tokens for r in token_output.token_output(docs, path, 2).collect()}
    assert ids == {d: n(t) + 1 for d, t, *_ in rows}


def test_token_output(docs, rows, library):
    got = by_row(token_output.token_output(docs, WORD_BPE, 2), "doc_id", "start", "n_tokens", "ids_crc32")
    at, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*library(t), 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want, key=repr)


def test_one_document_of_a_shard():
    ids = [np.arange(k, dtype="<u2") for k in (0, 1, 500, 70)]
    dictionary = b"".join(x.tobytes() for x in ids)
    frames = [token_output._zstd(dictionary)[0].compress(x.tobytes()) for x in ids]
    one = token_output.shard([5, None, 7, 8], frames, [len(x) for x in ids], dictionary, 2)
    content = (one + token_output.CLOSE) * 2
    found = list(token_output.shards(content))
    assert found == [one, one]
    index = token_output.index_of(one)
    assert index["doc_id"].tolist() == [5, 0, 7, 8] and index["null"].tolist() == [0, 1, 0, 0]
    assert token_output.document(one, index[2], dictionary).tolist() == ids[2].tolist()
    with pytest.raises(ValueError):
        token_output.document(one, index[2], b"another")
    with pytest.raises(ValueError):
        list(token_output.shards(content[:-3]))


# language


def test_language_spans_and_und(spark):
    en, de = "the house and the garden are with water", "das haus und der garten sind mit wasser"
    rows = [(k, " ".join([en if k % 2 else de] * 3), "en" if k % 2 else "de") for k in range(80)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, en), (2, de), (3, None), (4, "12 !?"), (5, f"{en} {en} {de} {de}"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, model, spans=True).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 6)] == ["en", "de", "und", "und", "und"]
    assert got[3].score == 0 and got[1].score == 1
    assert [s.split(":")[2] for s in got[5].spans] == ["en", "de"]
    assert {r.doc_id for r in language_id.recognised(asked, model).collect()} == {1, 2, 5}


def test_viterbi_equals_the_plain_one():
    rng = np.random.default_rng(1)
    m = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), np.zeros((1, 3)), np.zeros(3))
    bounds = np.array([0, 7, 7, 40, 41])
    scores = (rng.standard_normal((41, 3)) * 8).astype(np.float32)
    got = m.label(scores, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        def total(path):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - language_id.SWITCH * sum(x != y for x, y in zip(path, path[1:]))

        v, back = scores[a:a + 1].tolist()[0] if b > a else [], []
        for t in range(a + 1, b):
            step = [max((v[p] - language_id.SWITCH * (p != s), -p) for p in range(3)) for s in range(3)]
            back.append([-p for _, p in step])
            v = [x + scores[t, s] for s, (x, _) in enumerate(step)]
        if b > a:
            assert abs(max(v) - total(got[a:b])) < 1e-3


def test_language_by_brute_force(spark):
    """lang_pred, score and spans again: n-grams, candidates and Viterbi, a word and a language at a time."""
    import random

    rng = random.Random(4)
    pools = {"en": "the house and garden with water", "de": "das haus und der garten mit wasser", "ru": "дом и сад с водой мир", "el": "το σπίτι και ο κήπος"}
    rows = [(k, " ".join(rng.choices(pools[lang].split(), k=12)), lang) for k, lang in enumerate([*pools] * 20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [None, "", "12 !?", "తెలుగు భాష", "the дом haus", "x" * 400]
    for _ in range(60):
        texts.append(" ".join(" ".join(rng.choices([*pools[rng.choice([*pools])].split(), "7", "日本", "Дом-house"], k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))))
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, spans=True).collect()}
    bits = {x: 1 << k for k, x in enumerate(language_id.SCRIPTS)}
    of = lambda c: sum(bits[x] for x, ranges in language_id.SCRIPTS.items() if any(a <= ord(c) <= b for a, b in ranges))
    names = model.languages
    for k, text in enumerate(texts):
        words, letters = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()), []
        score = []
        for w in words:
            m, own = b" " + w + b"  ", 0
            for c in w.decode():
                own |= of(c)
            own = own or ((1 << language_id.OTHER) if any(c.isalpha() for c in w.decode()) else 0)
            letters.append(own > 0)
            total = np.zeros(len(names))
            for i in range(len(w)):
                three = ((m[i] * 0x01000193 ^ m[i + 1]) * 0x01000193 ^ m[i + 2]) & 0xFFFFFFFF
                four = (three * 0x01000193 ^ m[i + 3]) & 0xFFFFFFFF
                total += model.three[(three * 0x9E3779B1 & 0xFFFFFFFF) >> 16] + model.four[(four * 0x9E3779B1 & 0xFFFFFFFF) >> 16]
            total = total / 2
            fits = (model.scripts & own) > 0
            fits = fits if fits.any() else np.ones(len(names), bool)
            score.append(np.where(fits, total, total[fits].min() - language_id.FOREIGN) if own else np.zeros(len(names)))
        if not any(letters):
            assert (got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, [])
            continue
        v, back = score[0], []
        for s in score[1:]:
            jump = v.max() - language_id.SWITCH
            back.append([int(v.argmax()) if jump > x else j for j, x in enumerate(v)])
            v = np.maximum(v, jump) + s
        path = [int(v.argmax())]
        for b in reversed(back):
            path.insert(0, b[path[0]])
        votes = [sum(x == j for x, on in zip(path, letters) if on) for j in range(len(names))]
        assert got[k].lang_pred == names[int(np.argmax(votes))], text
        assert got[k].score == pytest.approx(max(votes) / sum(votes))
        edge = [i for i in range(len(path)) if not i or path[i] != path[i - 1]] + [len(path)]
        assert got[k].spans == [f"{a}:{b}:{names[path[a]]}" for a, b in zip(edge, edge[1:])]


def test_texts_of_megabytes(spark, library):
    """A text of 3 MB beside short ones, through what treats documents one by one."""
    big = " ".join(f"word{k % 9973} under the MIT License" if k % 50_000 == 0 else f"w{k % 9973}" for k in range(500_000))
    docs = spark.createDataFrame([(1, big), (2, "a short one"), (3, None)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    first = lambda df: df.where("doc_id = 1").first()
    assert first(license_scan.license_scan(docs)).n_base == 10
    assert first(language_id.language_id(docs)).lang_pred == "en"
    assert first(exact_dedup.exact_dedup(docs)).text_sha256 == hashlib.sha256(big.replace(" ", "").encode()).hexdigest()
    assert first(token_counts.token_counts(docs, WORD_BPE)).n_tokens == len(library(big)) == first(token_output.token_output(docs, WORD_BPE, 2)).n_tokens - 1
    scored = first(lm_scoring.lm_scores(docs))
    assert scored.n_tokens == len(big.split()) + 1 and np.isfinite(scored.score)


def test_language_held_out(docs, rows):
    got = {r.doc_id: r.held_out for r in language_id.language_id(docs).collect()}
    assert all(got[d] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in rows)


def test_scripts_narrow(spark):
    rows = [(k, "привет мир" if k % 2 else "hello world", "ru" if k % 2 else "en") for k in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language_id.predict(model, ["другое слово".encode(), b"other words"])["lang_pred"] == ["ru", "en"]


def test_letters_outside_the_table_vote(spark):
    te, am, en = "తెలుగు భాష చాలా అందమైన భాష", "አማርኛ ቋንቋ በጣም ቆንጆ ነው", "a house with a garden"
    rows = [(k, (te, am, en)[k % 3], ("te", "am", "en")[k % 3]) for k in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.predict(model, [t.encode() for t in (te, am, en, te + " house", "12 \u2014\u2014 \u20ac")])
    assert got["lang_pred"] == ["te", "am", "en", "te", "und"]
    assert got["score"][:3].tolist() == [1, 1, 1] and 0.7 < got["score"][3] < 1 and got["score"][4] == 0


# decontamination


def leaks(rows, items, n=10):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[a:a + k]), set()).add(i)
    for d, t in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit.update(range(a, a + k))
                    found |= windows[tuple(w[a:a + k])]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_without_an_id(spark, rows, kind):
    """Their words are hit, but they are not counted."""
    own = [(1, "a b c d"), (2, "x a b y"), (3, "nothing")]
    items = [(None, "a b"), (None, "c"), ("7" if kind == "string" else 7, "b c"), ("10" if kind == "string" else 10, "x"), (None, None)]
    bench = spark.createDataFrame(items, f"item_id {kind}, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontamination.leak_report(spark.createDataFrame(own, "doc_id long, text string"), bench).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (3, 1, sha("7")), 2: (3, 1, sha("10")), 3: (0, 0, sha(""))}
    kept = decontamination.without_leaks(spark.createDataFrame(own, "doc_id long, text string"), bench)
    assert [r.doc_id for r in kept.collect()] == [3]


def test_an_index_never_gets_more_buckets_than_spark_takes(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(exact_dedup, "BUCKET_BYTES", 1)
    monkeypatch.setattr(exact_dedup, "MOST_BUCKETS", 6)
    index = exact_dedup.DigestIndex
    monkeypatch.setattr(exact_dedup, "DigestIndex", lambda spark, at, buckets, *a: made.append(buckets) or index(spark, at, buckets, *a))
    assert exact_dedup.exact_dedup(docs).count() == docs.count()
    assert made == [6]


@pytest.mark.parametrize("block", [4 << 20, 200])
def test_leaks(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = [(1, " ".join(rows[15][1].split()[3:25])), (2, "W1 w2"), (3, None), (4, ""), (5, "w3"), (6, "w3"), (10, rows[15][1]), (9, "x" * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_row(decontamination.leak_report(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = list(leaks([(d, t) for d, t, *_ in rows], items))
    assert got == sorted(want, key=repr)
    kept = decontamination.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "keep this A b c d e f g h i J and that"), (2, None), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert by_row(decontamination.decontaminate(docs, bench), "doc_id", "text") == [(1, "keep this  and that"), (2, None), (3, "clean")]


def test_no_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leak_report(docs, none).where("contaminated").count() == 0


def test_fm_index_finds_all():
    from tarn.llm.fm_index import FMIndex, ranges

    rng = np.random.default_rng(3)
    text = rng.integers(1, 4, 400).astype(np.int32)
    text[[40, 41, 200, 399]] = 0
    index = FMIndex(text, 3)
    patterns = rng.integers(1, 4, (60, 3)).astype(np.int32)
    which, found = ranges(*index.search(patterns))
    got = sorted(zip(which.tolist(), index.locate(found).tolist()))
    want = [(k, i) for k, p in enumerate(patterns) for i in range(398) if (text[i:i + 3] == p).all()]
    assert got == sorted(want)


# licences


def test_license_places(docs, rows):
    got = by_row(license_scan.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for d, t, *_ in rows:
        w = ALNUM.findall(lower(t))
        at = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        want.append((d, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=repr)


def test_license_templates():
    s = license_scan.Scanner(license_scan.BASE, license_scan.TEXTS)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    full = dict(license_scan.TEXTS[:10])
    texts = [mit, mit.replace("to deal in", "to deal with"), "the GNU General Public License, version 3", "the gnu general public license version 2 of", "nothing of the kind", "Redistribution and use in source and binary forms only"]
    texts += ["a b c " + full["bsd-2"] + " d e", full["mit"].replace("WITHOUT WARRANTY", "with no warranty")]
    got = s.scan([t.encode() for t in texts])
    assert got["labels"] == ["mit", "mit", "gpl-3", "gpl-2", "", "", "bsd,bsd-2", "mit"]
    assert got["score"][0] == 1 and 0.9 <= got["score"][1] < 1 and got["score"][4] == 0 and 0 < got["score"][5] < 0.9
    n = len(ALNUM.findall(lower(full["bsd-2"])))
    assert f"3:{3 + n}:bsd-2" in got["spans"][6] and got["spans"][2] == ["0:7:gpl-3"] and got["spans"][4] == []


def brute_labels(words, templates):
    """Labels, score and spans: every end in the text against every end in every template, chains by trying all."""
    best = {}
    for number, (t, _) in enumerate(templates):
        seen = []
        for e, at in ((e, at) for e in range(1, len(words) + 1) for at in range(1, len(t) + 1)):
            k = 0
            while k < min(e, at) and words[e - 1 - k] == t[at - 1 - k]:
                k += 1
            if k < license_scan.LEAST or (e < len(words) and at < len(t) and words[e] == t[at]):
                continue
            got, start = k, e - k
            for e2, at2, had, began in seen:
                lap = max(0, e2 - (e - k), at2 - (at - k))
                if e2 < e and at2 < at and lap < k and e2 + license_scan.GAP >= e - k and had + k - lap > got:
                    got, start = had + k - lap, began
            seen.append((e, at, got, start))
            if got > best.get(number, (0,))[0]:
                best[number] = (got, start, e)
    enough = {n: b for n, b in best.items() if (b[0] == len(templates[n][0]) if len(templates[n][0]) < license_scan.LONG else b[0] >= license_scan.COVERED * len(templates[n][0]))}
    return {templates[n][1] for n in enough}, max((b[0] / len(templates[n][0]) for n, b in best.items()), default=0.0), sorted({f"{x}:{y}:{templates[n][1]}" for n, (_, x, y) in enough.items()})


def test_license_labels_by_brute_force(spark):
    import random

    rng = random.Random(8)
    known = [("mit", "a b c d e f g h i j k l"), ("gpl", "a b c x y z d e f g"), ("short", "x y z w"), ("part", "c d e f"), ("cc", "p q r p q r s t")]
    rows = []
    for k in range(250):
        w = []
        for _ in range(rng.randrange(6)):
            t = rng.choice(known)[1].split()
            i = rng.randrange(len(t))
            w += t[i : i + rng.randrange(1, 13)] + rng.choices("abcdxyzpqr#", k=rng.randrange(4))
        rows.append((k, " ".join(w)))
    every = [*((p.split(), x) for p, x in license_scan.BASE.items()), *((t.split(), x) for x, t in known)]
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=known).collect():
        labels, score, spans = brute_labels(ALNUM.findall(rows[r.doc_id][1]), every)
        assert (r.labels, r.spans) == (",".join(sorted(labels)), spans), rows[r.doc_id]
        assert r.score == pytest.approx(score)


def test_automaton_matching_statistics():
    a = license_scan.SuffixAutomaton([[1, 2, 3, 1, 2], [2, 3, 3]])
    subs = {tuple(s[i:j]) for s in ([1, 2, 3, 1, 2], [2, 3, 3]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [1, 2, 3, 3, 1, 2, 3, 1, 2, 2, 3, 3, 9, 1]
    want = [max((k for k in range(i + 2) if tuple(text[i + 1 - k:i + 1]) in subs or k == 0)) for i in range(len(text))]
    assert [n for _, n in a.stream(text)] == want


# pieces


def test_pieces(docs, rows):
    c = sentencepiece_codec.codec(PIECES)
    got = by_row(sentencepiece_codec.encode(docs, PIECES).drop("ids"), "doc_id", "n_tokens", "ids_crc32", "decoded")
    want = [(d, len(i := c.lib.encode(t or "")), zlib.crc32(np.array(i, "<u4").tobytes()), True) for d, t, *_ in rows]
    assert got == sorted(want, key=repr)
    back = by_row(sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES), "doc_id", "text")
    assert back == sorted(((d, t or "") for d, t, *_ in rows), key=repr)


def test_max_plus_scan_equals_the_library(monkeypatch):
    import random

    monkeypatch.setattr(sentencepiece_codec, "CHUNK", 32)
    c, rng = sentencepiece_codec.codec(PIECES), random.Random(2)
    pools = [["the", "ing", " ", "  ", "\n", "é", "日", "🙂", "==", "aaa", "1"], ["a", "b", "th", "e", "in", "g", "o"]]
    for k in range(120):
        text = "".join(rng.choice(pools[k % 2]) for _ in range(rng.randrange(1, 120)))
        parts = [sentencepiece_codec.Chunk(c, *x) for x in sentencepiece_codec.chunks(text, c.longest)]
        path = sentencepiece_codec.scan([p.matrix() for p in parts])
        ids = b"".join(p.trace(*s) for p, s in zip(parts, path))
        assert np.frombuffer(ids, c.width).tolist() == c.lib.encode(text), text


def test_combination_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random(s) < 0.5, 0, -np.inf).astype(np.float32) for s in ((3, 4), (4, 2), (2, 5)))
    f = sentencepiece_codec.combine
    assert np.array_equal(f(f(a, b), c), f(a, f(b, c)))


# language model


def test_lm_scores(docs, rows):
    from collections import Counter
    from math import log10

    n, tokens = Counter(), {}
    for d, t, *_ in rows:
        w = [*re.findall("[^\x20\x09-\x0d]+", lower(t)), None]
        tokens.setdefault(d, []).append(w)
        if zlib.crc32(str(d).encode()) % 5 != 1:
            n.update(w)
    total, distinct = sum(n.values()), len(n)
    for r in lm_scoring.lm_scores(docs).collect():
        w = tokens[r.doc_id][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(w), sum(n[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(log10((n[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
        assert r.score < 0


@pytest.mark.parametrize("least", [1, 20])
def test_lm_score_word_by_word(docs, rows, monkeypatch, least):
    monkeypatch.setattr(lm_scoring, "LEAST_FREQUENT", least)
    """The whole score again: counts, classes and one step of the network a word, in plain Python."""
    from collections import Counter

    from tarn.llm.words import words_of

    kept, train = {}, lm_scoring._train

    def spy(model, *rest):
        train(model, *rest)
        kept["model"] = model

    monkeypatch.setattr(lm_scoring, "_train", spy)
    got = lm_scoring.lm_scores(docs).collect()
    model, words = kept["model"], {d: re.findall("[^\x20\x09-\x0d]+", lower(t)) for d, t, *_ in rows}
    n = Counter(w for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in words[d])
    every = sorted({w for ws in words.values() for w in ws})
    w = words_of([x.encode() for x in every], lm_scoring.KIND)
    hashed, tail = dict(zip(every, w.hash.tolist())), dict(zip(every, lm_scoring.tails(w).tolist()))
    signed = lambda x: hashed[x] - (hashed[x] >> 63 << 64)
    frequent = sorted(n, key=lambda x: (-n[x], signed(x)))[: max(least, int(np.ceil(len(n) ** 0.5)))]
    number = {x: k for k, x in enumerate(sorted(frequent, key=hashed.get))}
    mass = Counter()
    for x, c in n.items():
        if x not in number:
            mass[tail[x]] += c + 0.5
    end = len(frequent) + lm_scoring.TAILS
    assert len(model.mass) == end + 1
    for r in got:
        state, before, total = np.zeros((1, model.u.shape[0]), np.float32), end, 0.0
        for x in [*words[r.doc_id], None]:
            symbol = end if x is None else number.get(x, len(frequent) + tail[x])
            state = model.step(model.x[[before]].copy(), state)
            total += float(model._log_softmax(state, np.array([symbol]))[0])
            if x is not None and x not in number:
                total += np.log((n[x] + 0.5) / (mass[tail[x]] + 0.5))
            before = symbol
        assert r.score == pytest.approx(total / np.log(10), rel=1e-3, abs=1e-3)


def test_lm_learns_from_every_document(spark, monkeypatch):
    """More tokens than one shard has: each training document is in one lesson, whole."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 50, 20_000))) for k in range(44)] + [(k, f"w{k % 7} end") for k in range(44, 2500)]
    found = []
    train = lm_scoring._train

    def spy(model, lessons, *rest):
        for r in lessons.collect():
            symbols, sizes = lm_scoring.unpack(r.payload)
            assert len(symbols) == sizes.sum() == r.tokens
            assert (symbols[np.cumsum(sizes) - 1] == len(model.mass) - 1).all()
            found.extend(sizes.tolist())
        before = model.weights()
        train(model, lessons, *rest)
        assert (model.weights() != before).any()

    monkeypatch.setattr(lm_scoring, "_train", spy)
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 300_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scores = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    assert sorted(found) == sorted(r.n_tokens for r in scores.values() if not r.held_out)
    assert sum(found) == scores[0].train_tokens > 600_000


def test_lm_learns_alike_with_one_shard(docs, monkeypatch):
    """A table of one shard is learned from in the rounds of a large one, each document once."""
    import copy

    train, seen = lm_scoring._train, []

    def spy(model, lessons, shards, rounds, scratch):
        own, rows = copy.deepcopy(model), {r["round"]: r.payload for r in lessons.collect()}
        train(model, lessons, shards, rounds, scratch)
        for r in range(lm_scoring.ROUNDS):
            if r in rows:
                symbols, sizes = lm_scoring.unpack(rows[r])
                own.train(np.split(symbols, np.cumsum(sizes)[:-1]), 1, r / lm_scoring.ROUNDS, (r + 1) / lm_scoring.ROUNDS)
        seen.append((shards, rounds, len(rows)))
        assert np.allclose(model.weights(), own.weights(), atol=1e-3)

    monkeypatch.setattr(lm_scoring, "_train", spy)
    lm_scoring.lm_scores(docs).count()
    assert seen[0][:2] == (1, lm_scoring.ROUNDS) and seen[0][2] > 1


def test_gru_is_a_distribution_and_learns():
    from tarn.llm.gru import GRU

    docs = [np.array([1, 2, 3, 1, 2, 3, 5]), np.array([2, 3, 1, 2, 5]), np.array([5])] * 4000
    m = GRU(np.bincount(np.concatenate(docs), minlength=6).astype(float))
    before = m.log_likelihood(np.concatenate(docs[:3]), np.array([7, 5, 1])).sum()
    m.train(docs)
    assert m.log_likelihood(np.concatenate(docs[:3]), np.array([7, 5, 1])).sum() > before + 3
    p = [np.exp(m.log_likelihood(np.array([1, 2, s]), np.array([3]))[2]) for s in range(6)]
    assert sum(p) == pytest.approx(1, abs=1e-4)
    whole = m.log_likelihood(np.tile([1, 2, 3], 100), np.array([300]))
    state, each, before_ = np.zeros((1, m.u.shape[0]), np.float32), [], 5
    for s in np.tile([1, 2, 3], 100):
        state = m.step(m.x[[before_]].copy(), state)
        each.append(m._log_softmax(state, np.array([s]))[0])
        before_ = s
    assert np.allclose(whole, each, atol=1e-4)  # the state crosses windows


def test_gru_gradients():
    from tarn.llm.gru import GRU

    rng = np.random.default_rng(0)
    m = GRU(np.ones(9))
    for k in ("x", "u", "b", "wc", "bc", "ws"):
        setattr(m, k, (getattr(m, k) + rng.standard_normal(getattr(m, k).shape) * 0.3).astype(np.float64))
    symbols = rng.integers(0, 9, 12)
    index, start = np.arange(12).reshape(6, 2).astype(np.int32), np.zeros((6, 2), bool)
    start[0] = start[3, 1] = True
    before = symbols[::-1].reshape(6, 2).copy()
    h0 = np.zeros((2, m.u.shape[0]))

    def loss():
        seen, h = [], h0
        for t in range(6):
            h = m.step(m.x[before[t]].copy(), np.where(start[t][:, None], 0, h))
            seen.append(h)
        return -m._log_softmax(np.stack(seen)[index >= 0], symbols[index[index >= 0]]).mean()

    grads, _ = m._window(before, start, index, symbols, h0)
    for k in ("x", "u", "b", "wc", "bc", "ws"):
        a = getattr(m, k)
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in a.shape)
            if k == "ws" and np.isinf(m.bs[at[:2]]):
                continue
            old, eps = a[at], 1e-5
            a[at] = old + eps
            up = loss()
            a[at] = old - eps
            down = loss()
            a[at] = old
            assert grads[k][at] == pytest.approx((up - down) / 2 / eps, abs=2e-3)


# edges


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for f in (
        exact_dedup.exact_dedup, language_id.language_id, license_scan.license_scan, lm_scoring.lm_scores, lambda d: token_counts.token_counts(d, WORD_BPE),
        lambda d: token_output.token_output(d, WORD_BPE, 2), lambda d: decontamination.leak_report(d, bench), lambda d: sentencepiece_codec.encode(d, PIECES),
    ):
        assert f(empty).count() == 0


def test_rows_without_ids(spark, no_ids):
    bench = spark.createDataFrame([(1, "some words in a row")], "item_id long, text string")
    for f in (
        exact_dedup.exact_dedup, language_id.language_id, license_scan.license_scan, lm_scoring.lm_scores, lambda d: token_counts.token_counts(d, WORD_BPE),
        lambda d: token_output.token_output(d, WORD_BPE, 2), lambda d: decontamination.leak_report(d, bench), lambda d: sentencepiece_codec.encode(d, PIECES),
    ):
        assert sorted(str(r.doc_id) for r in f(no_ids).collect()) == ["7", "None", "None"]


def test_scratch_is_never_on_a_machine_of_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tarn.llm import shared

    assert shared.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    with pytest.raises(ValueError, match="own disk"):
        shared._reached_by_all(spark, "file:/tmp/warehouse/tarn-scratch")

    def session(master, **conf):
        context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId="an application")
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)), _jvm=spark._jvm, _jsc=spark._jsc)

    monkeypatch.setattr(shared, "_OWN_DIRS", {})
    own = shared.shared_dir(session("local[2]"))
    assert own.startswith("file:///") and shared.shared_dir(session("local[2]")) == own
    with pytest.raises(ValueError, match="own disk"):
        shared.shared_dir(session("spark://host:7077", **{"spark.sql.warehouse.dir": "file:/data/warehouse"}))
    assert shared.shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "file:/shared/", "spark.sql.warehouse.dir": "file:/data"})) == "file:/shared"


def test_leaks_and_pieces_of_megabytes(spark):
    """A text of some 3 MB: every occurrence is found, at its ends too; its pieces are the library's."""
    import sentencepiece

    words = [f"w{k % 9973}" for k in range(500_000)]
    passage = [f"leak{k}" for k in range(12)]
    for at in (0, 250_000, len(words) - 12):
        words[at:at + 12] = passage
    rows, items = [(1, " ".join(words)), (2, "a short one"), (3, None), (4, " ".join(passage[:10]))], [(7, " ".join(passage)), (8, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w11")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(decontamination.leak_report(docs, spark.createDataFrame(items, "item_id long, text string")), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(leaks(rows, items), key=repr) and got[0][2] == 36
    ids = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(rows[0][1])
    pieces = sentencepiece_codec.encode(docs.where("doc_id = 1"), PIECES).first()
    assert (pieces.n_tokens, pieces.ids_crc32, pieces.decoded) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
