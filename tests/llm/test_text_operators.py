"""Operators that look at one document at a time, against plain versions and the tokenizers library."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import bpe, decontaminate, language_model, outliers, quality, token_store, toxicity, warc
from basketry.llm.shared import held_out
from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    counts = collections.Counter(zip(found, found[1:], found[2:]))
    covered = {k + d for k in range(len(found) - 2) if counts[tuple(found[k:k + 3])] > 1 for d in range(3)}
    return (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_outlier_stats_and_rules(odd, no_rows, corpus):
    rows = odd.unionByName(corpus[0], allowMissingColumns=True)
    got = outliers.robust_outliers(rows).collect()
    texts = collections.Counter((r.doc_id, plain_stats(r.text)) for r in rows.collect())
    assert collections.Counter((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert outliers.robust_outliers(no_rows).count() == 0


def test_outliers_leave_prose_and_reject_symbols(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(80, 200)), "en", "a", 0) for i in range(120)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng, 100).split()), "en", "a", 0) for i in range(12)]
    got = {r.doc_id: r.kept for r in outliers.robust_outliers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] for i in range(120)) >= 118
    assert not any(got[1000 + i] for i in range(12))


def test_graded_outliers_in_a_concentrated_group(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randint(120, 240)), "en", "a", 0) for i in range(500)]
    far = {}
    for share in (0.1, 0.15, 0.2, 0.3, 0.4):
        for _ in range(3):
            text = prose(rng, 240)
            spots = [k for k, c in enumerate(text) if c.isalpha()]
            marked = set(rng.sample(spots, int(share * len(spots)) + 1))
            far[1000 + len(far)] = "".join("#" if k in marked else c for k, c in enumerate(text))
            lines = text.split("\n")
            far[1000 + len(far)] = "\n".join(lines + [lines[3]] * round(len(lines) * share / (1 - share) + 0.5))
    rows += [(i, text, "en", "a", 0) for i, text in far.items()]
    got = {r.doc_id: r for r in outliers.robust_outliers(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not [i for i in far if got[i].kept]
    assert sum(not got[i].base_failed for i in far) > 20  # the distance rejects them
    assert sum(got[i].kept for i in range(500)) >= 495


def test_mcd_inverse_matches_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("en", "a", 0, *map(float, r)) for r in z], "lang string, source string, start int, "
                               + ", ".join(f"z{k} double" for k in range(5)))
    settings = outliers.Settings(ridge=0.1, prior_rows=4.0)
    row = outliers.inverted(outliers.moments(df, ["lang", "source", "start"], [df[f"z{k}"] for k in range(5)], settings)).first()
    scatter = (np.cov(z.T, bias=True) * len(z) + 4.0 * np.eye(5)) / (len(z) + 4.0) + 0.1 * np.eye(5)
    for a, b in outliers.CELLS:
        assert row[f"q{a}{b}"] == pytest.approx(np.linalg.inv(scatter)[a, b], rel=1e-8)
    assert row.logdet == pytest.approx(np.linalg.slogdet(scatter)[1])


def test_quality_learns_from_positives_only(corpus, odd, no_rows):
    docs, labels = corpus
    model = quality.train(docs, labels, quality.Settings(rounds=300))
    assert 0.5 < model.prior < 0.8  # two thirds are good
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    far = [r for r in out if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in far]) > 0.9
    assert quality.score(odd, model).count() == odd.count()
    assert quality.classify(no_rows, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_prior_estimate():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 3000), rng.normal(-3, 1, 1000)])
    assert quality.estimate_prior(positive, mixed) == pytest.approx(0.75, abs=0.06)


def test_toxicity(corpus, odd, no_rows):
    docs, labels = corpus
    settings = toxicity.Settings(min_rows=4)
    model = toxicity.train(docs, labels, settings)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity.score(docs, model, settings).collect()
    far = [r for r in out if r.held_out and truth[r.doc_id] is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in far]) > 0.9
    scores = [r.score for r in toxicity.score(odd, model, settings).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.classify(no_rows, labels).count() == 0
    assert {r.predicted for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0}


def test_character_ngrams_by_brute_force():
    slots = np.arange(toxicity.BUCKETS, dtype=np.int32)
    texts = ["Ab  cab", "", "ca"]
    found = {k: set(v.tolist()) for k, v in toxicity.present([t.encode() for t in texts], slots, 2, 3)}
    distinct = [{f" {' '.join(t.lower().split())} "[i:i + n] for n in (2, 3) for i in range(len(f" {' '.join(t.lower().split())} ") - n + 1)} for t in texts]
    assert [len(found[k]) for k in range(3)] == [len(x) for x in distinct]
    assert len(found[0] & found[2]) == len(distinct[0] & distinct[2])


def test_bpe_and_token_store_match_the_library(spark, odd, no_rows):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    texts = {}
    for r in bpe.encode(odd).collect():
        texts.setdefault(r.doc_id, []).append((list(r.ids), r.decoded))
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (ids, library.decode(ids, skip_special_tokens=False)) in texts[r.doc_id]
    for r in bpe.encode_digests(odd).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in [
            (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
            for i, d in texts[r.doc_id]]
    assert bpe.encode_digests(no_rows).count() == 0
    library = Tokenizer.from_file(token_store.VOCABULARY)
    at, rows = 0, {}
    for r in token_store.token_round_trip(spark, odd).collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) in rows[r.doc_id]
        at += len(ids)
    assert token_store.token_round_trip(spark, no_rows).count() == 0


def test_each_piece_is_asked_for_once_a_batch(monkeypatch):
    monkeypatch.setattr(token_store, "PIECES_KEPT", 5)
    known = token_store.PieceEncoder(token_store.VOCABULARY)
    asked, ids_of = [], known.known.ids_of
    known.known.ids_of = lambda piece: asked.append(piece) or ids_of(piece)
    texts = ["It's we're 12 x's 'tis\n\n  odd  ", "a bc 'll'd a bc\xa0\x85 it's", "", " ", "a bc a bc more"]
    for _ in range(2):
        got = known.encode(texts)
        assert got == [np.array(known.library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert len(known.known) == 5 and len(asked) == len(set(asked))
        asked = [p for p in asked if p in known.known]
        known.known.ids_of = lambda piece, asked=asked: asked.append(piece) or ids_of(piece)


def test_speculation_equals_merging():
    merges = bpe.encoder(bpe.VOCABULARY).merges
    rng = random.Random(2)
    some = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 16))) + bpe.END for _ in range(3000)]
    some += ["a" * n + bpe.END for n in range(1, 40)]
    found, failed = merges.words(some)
    assert found == [merges.exact(w) for w in some]
    assert 0 < failed < len(some)


def test_token_files_are_selective(spark, tmp_path, odd):
    import pyarrow.parquet as pq

    manifest = token_store.write_tokens(odd, str(tmp_path / "t"), encoding="delta", group_tokens=1000)
    files = list((tmp_path / "t").glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_row_groups for m in meta) > len(files)
    column = meta[0].row_group(0).column(3)
    assert column.has_column_index and column.has_offset_index and "DELTA_BINARY_PACKED" in column.encodings
    plan = token_store.read_tokens(spark, str(tmp_path / "t"), manifest).select("doc_id", "start")._jdf.queryExecution().toString()
    assert "tokens" not in plan.split("ReadSchema")[-1]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, None, "same"), (9, "http://b\r\nx", "same"), (9, "http://b\r\nx", "same"), (3, "u", None),
            (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(pages, folder, file_bytes=300)
    assert sum(r.records for r in manifest.collect()) == len(rows) and manifest.count() > 1
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest, folder).collect()), key=str)
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    last = {"same": 9, "": 4, "é" * 400_000: 5}
    expected = []
    for page, _, html in rows:
        data, to = (html or "").encode(), last[html or ""]
        visit = page is not None and page != to
        expected.append((page, "revisit" if visit else "response", to if visit else None, len(data), digest(data)))
    assert got == sorted(expected, key=str)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_warc_damage_is_found():
    record = warc.build_record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    good = warc.gzip_member(record) * 2
    assert [warc.read_record(m)["payload"] for m in warc.members(io.BytesIO(good))] == [b"payload"] * 2
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(good[:-5])))
    with pytest.raises(ValueError):
        warc.read_record(record.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.read_record(record + b"x")


def test_language_model(spark, odd, no_rows, corpus):
    docs = corpus[0].unionByName(odd.select(corpus[0].columns))
    got = language_model.score_by_fold(docs).collect()
    rows = docs.collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 != 1:
            counts.update(tokens(r.text))
    total, types = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for r in rows:
        words = tokens(r.text)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        expected[r.doc_id, len(words), sum(counts[w] > 0 for w in words), round(base, 4)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == expected
    assert all(r.train_tokens == total and r.score <= 0 for r in got)
    # several broadcast rounds give the same scores
    one = sorted((str(r.doc_id), round(r.score, 6)) for r in got)
    training = docs.where(~held_out(1))
    several = language_model.score_documents(docs, training, round_bytes=4096, segment_bits=12).collect()
    single = language_model.score_documents(docs, training, segment_bits=12).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in several) == sorted((str(r.doc_id), round(r.score, 6)) for r in single)
    assert np.mean([abs(a[1] - b[1]) < 0.05 * abs(b[1]) for a, b in zip(one, sorted((str(r.doc_id), round(r.score, 6)) for r in single))]) > 0.9
    assert language_model.score_by_fold(no_rows).count() == 0


def test_bloom_levels_never_fall_short():
    grams = np.random.default_rng(3).integers(0, 2**63, 4000).astype(np.uint64)
    tops = np.arange(4000) % 6
    words = np.zeros(1 << (language_model.SEGMENT_BITS - 6), dtype=np.uint64)
    for level in range(1, 6):
        np.bitwise_or.at(words, *language_model.words_and_masks(grams[tops >= level], level))
    found = language_model.probe_levels(grams, 0, 1, 1, words)
    assert (found >= tops).all() and (found != tops).mean() < 0.01


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k = rng.randrange(len(out))
        out[k:k + 1] = rng.choice([[], [rng.choice("xyz")], [out[k], rng.choice("xyz")]])
    return "".join(out)


def fewest_edits(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_by_brute_force(spark, odd, no_rows):
    rng = random.Random(4)
    bench = [(i, prose(rng, 18)) for i in range(8)] + [(90, None), (91, "short"), (None, prose(rng, 20)), (0, prose(rng, 16))]
    benchmark = spark.createDataFrame(bench, "item_id long, text string").withColumnRenamed("other", "x")
    rows = []
    for i in range(60):
        text, item = prose(rng, 40), rng.choice(bench[:8])[1]
        at = rng.randrange(len(text))
        rows.append((i, text[:at] + " " + edited(rng, item, rng.randint(0, len(item) // 7)) + " " + text[at:] if i % 2 else text, "en", "a", 1))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs, benchmark).collect()}
    expected = {}
    for doc_id, text, *_ in rows:
        text = decontaminate.normalise(text)
        for item, passage in bench:
            passage = decontaminate.normalise(passage or "")
            if item is None or len(passage) < decontaminate.Q:
                continue
            budget = min(int(0.1 * len(passage)), (len(passage) - 8) // 8)
            if (edits := fewest_edits(passage, text)) <= budget:
                expected[doc_id, item] = min(edits, expected.get((doc_id, item), edits))
    assert got == expected and len({d for d, _ in got}) > 8
    blocks = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs, benchmark, block_chars=300).collect()}
    assert blocks == got
    left = decontaminate.drop_leaks(docs, benchmark)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.find_leaks(no_rows, benchmark).count() == 0


def test_bpe_of_many_special_tokens():
    """A hundred thousand marks in one text, against the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = bpe.WordEncoder(path)
    text = "Word<|endoftext|>[SEP] " * 50_000 + "end"
    ids, shown = coder.encode([text])
    library = Tokenizer.from_file(path)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids[0] == " ".join(map(str, want)) and shown[0] == library.decode(want, skip_special_tokens=False)


def test_repeated_ids_do_not_multiply(spark, corpus):
    """Thousands of rows of one id add one row to what the driver learns from."""
    docs, labels = corpus
    copies = docs.where("doc_id in (1, 2, 4)").withColumn("text", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(3_000)), lambda k: F.concat("text", F.lit(" "), k.cast("string")))))
    many = docs.unionByName(copies)
    assert quality.classify(many, labels).count() == toxicity.classify(many, labels).count() == many.count()
    model = quality.train(many, labels)
    assert model is not None


def test_repetitive_passages_meet_repetitive_texts_in_chunks():
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(50)]
    passages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 60)))) for i in range(30)]
    passages += [(90, "ab " * 200), (91, "cd " * 200 + "zz"), (92, None)]
    found = decontaminate.index_passages(passages, decontaminate.Q, decontaminate.EDIT_RATE)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(150)) + " " + rng.choice(passages[:30])[1] for _ in range(12)]
    texts += ["ab " * 700, "", "ab " * 300 + "cd " * 300]
    chars = decontaminate.code_points("\n".join(decontaminate.normalise(x) for x in texts))
    whole = decontaminate.candidate_bands(found, chars, 1 << 30)
    assert len(whole[0]) > 12
    for chunk in (5_000, 60_000):
        assert all(np.array_equal(x, y) for x, y in zip(whole, decontaminate.candidate_bands(found, chars, chunk)))
    # 7 million shared q-grams, most of them at a few places of the passage again and again
    long = ("ab " * 36_000)[:18_000] + ("cd " * 36_000)[:18_000]
    hits = {item: edits for _, item, _, _, edits in decontaminate.occurrences(found, [long])}
    assert hits[30] == 0 and hits[31] == 2
