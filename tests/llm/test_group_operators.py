"""Operators that link documents or lines, and the pipeline, against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from basketry.llm import bpe, decontaminate, entry, line_dedup, simhash
from basketry.llm.shared import components
from tests.llm.conftest import SCHEMA, prose


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_chains_stars_and_pairs(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 400)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    pairs += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(160)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if None not in (a, b) and a != b]
    assert got == union_find({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_groups(spark, odd, no_rows):
    rng = random.Random(6)
    base = prose(rng, 300).split(" ")
    rows = [(i, prose(rng, 30), "en", "a", 0) for i in range(100, 160)]
    for i in range(200, 260):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    prints = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    marks = sorted({p for _, p in prints})
    roots = union_find(marks, [(a, b) for i, a in enumerate(marks) for b in marks[i + 1:] if (a ^ b).bit_count() <= 2])
    lowest = {}
    for doc_id, mark in prints:
        if doc_id is not None:
            lowest[roots[mark]] = min(doc_id, lowest.get(roots[mark], doc_id))
    expected = collections.Counter((d, f"{m:016x}", lowest.get(roots[m], d)) for d, m in prints)
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs).collect())) == expected
    assert len(set(lowest.values())) < len(rows)
    assert collections.Counter(map(tuple, simhash.near_duplicates(odd).select("doc_id").collect())) == collections.Counter(
        map(tuple, odd.select("doc_id").collect()))
    assert simhash.near_duplicates(no_rows).count() == 0
    stay = sorted((r.doc_id for r in simhash.keep_first(docs).where("doc_id is not null").collect()))
    assert stay == sorted({low for d, _, low in expected if d == low})
    assert simhash.keep_first(odd).columns == odd.columns


def test_full_tiles_are_cut_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    marks = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)})
    signed = [m - (m >> 63 << 64) for m in marks]
    got = simhash.links(spark.createDataFrame([(m,) for m in signed], "print long"), 2).collect()
    close = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert union_find(signed, [(r.a, r.b) for r in got]) == union_find(signed, close)
    assert len(got) < len(close)


def plain_lines(rows, spark):
    """Removed positions by comparing all lines with one another."""
    spots = collections.defaultdict(list)
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            line = re.sub(r"[ \t\x0b\f\r]+", " ", line.lower()).strip(" ")
            if len(line.split(" ")) >= 5:
                spots[line].append((doc_id is None, doc_id, pos))
    lines = sorted(spots)
    bags = spark.createDataFrame([(k,) for k in lines], "line string").select(
        "line", F.transform(F.array_distinct(F.split("line", " ")), lambda x: F.xxhash64(x)).alias("h"))
    marks = {}
    for r in bags.collect():
        marks[r.line] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.h) > len(r.h))

    def similar(a, b):
        edits = duckdb.execute("select levenshtein(?, ?)", [a, b]).fetchone()[0]
        return edits <= int(max(len(a), len(b)) * 0.2 + 1e-9)

    links = [(a, b) for i, a in enumerate(lines) for b in lines[i + 1:]
             if (marks[a] ^ marks[b]).bit_count() <= line_dedup.RADIUS and similar(a, b)]
    groups = collections.defaultdict(set)
    for line, root in union_find(lines, links).items():
        groups[root].update(spots[line])
    gone = collections.defaultdict(set)
    for spot in groups.values():
        for _, doc_id, pos in sorted(spot)[1:]:
            gone[doc_id].add(pos)
    return {k: sorted(v) for k, v in gone.items()}, len(links)


def test_fuzzy_lines(spark, odd, no_rows):
    rng = random.Random(8)
    common = [prose(rng, 12) for _ in range(4)]
    rows = []
    for i in range(60):
        lines = prose(rng, 60).split("\n")
        for line in rng.sample(common, 2):
            if rng.random() < 0.6:  # a fuzzy copy: another letter or a doubled blank
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(["s", "  ", "T"]) + line[at + 1:]
            lines.insert(rng.randrange(len(lines) + 1), line)
        rows.append((i, "\n".join(lines + ["too few words"])))
    long = " ".join(prose(rng, 300).split())
    for i in range(60, 85):  # many like lines in the same buckets
        at = rng.randrange(len(long))
        rows.append((i, long[:at] + "q" + long[at + 1:]))
    expected, links = plain_lines(rows, spark)
    docs = spark.createDataFrame([(*r, "en", "a", len(r[1])) for r in rows], SCHEMA)
    got = {r.doc_id: list(r.removed) for r in line_dedup.mark_lines(docs).collect() if r.n_removed}
    assert got == expected
    assert links > 50
    after = {r.doc_id: r for r in line_dedup.drop_lines(docs).collect()}
    for doc_id, text in rows:
        kept = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected.get(doc_id, []))
        assert after[doc_id].text == kept and after[doc_id].n_chars == len(kept)
    left = line_dedup.drop_lines(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    marked = line_dedup.mark_lines(odd).collect()
    # the text of 5 stays, those of 6 and of the row without an id go
    assert {r.doc_id: r.n_removed > 0 for r in marked if r.doc_id in (None, 5, 6)} == {None: True, 5: False, 6: True}
    assert line_dedup.mark_lines(no_rows).count() == 0


def test_native_plans_have_no_python(spark, corpus, capsys):
    from basketry.llm import outliers

    for frame in (line_dedup.simhashes(line_dedup.lines_of(corpus[0], min_words=5).withColumn("id", F.xxhash64("line"))), line_dedup.mark_lines(corpus[0]), outliers.robust_outliers(corpus[0])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline_stages(spark, corpus, tmp_path):
    docs, labels = corpus
    bench = [(1, docs.where("doc_id = 5").first().text[:200]), (2, "no such passage " * 10)]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    current, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, current, str(tmp_path)).write.parquet(path)
        before, current = current, spark.read.parquet(path)
        counts.append(current.count())
        if stage is not corpus_pipeline.token_digests:
            assert current.columns == docs.columns
        if stage is corpus_pipeline.good_documents:
            kept = {r.doc_id for r in current.select("doc_id").collect()}
            assert np.mean([i in kept for i in range(240) if truth[i] == 1]) > 0.97
            assert np.mean([i in kept for i in range(240) if truth[i] == 0]) < 0.15
        if stage is corpus_pipeline.clean_documents:
            passage = decontaminate.normalise(bench[0][1])
            assert not any(passage in decontaminate.normalise(r.text) for r in current.collect())
            assert any(passage in decontaminate.normalise(r.text) for r in before.collect())
    library = Tokenizer.from_file(bpe.VOCABULARY)
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in current.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


def test_registered_queries(spark):
    names = list(entry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


def test_archives_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    expected = base.execute(entry.OP3_SQL).fetchall()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, entry.op3_warc(spark, folder).select(columns).collect())) == sorted(expected)


def test_lines_with_changed_words_and_letters_are_linked(spark):
    rng = random.Random(21)
    lines, pairs = [], 0
    for size in (5, 8, 12, 20, 40, 60) * 12:
        line = prose(rng, size).replace("\n", " ").lower()
        copy = line.split(" ")
        copy[rng.randrange(size)] = "other"
        letters = list(line)
        for at in rng.sample(range(len(letters)), len(letters) // 10):
            letters[at] = "x"
        for other in (" ".join(copy), "".join(letters)):
            edits = duckdb.execute("select levenshtein(?, ?)", [line, other]).fetchone()[0]
            if other != line and len(other.split(" ")) >= 5 and edits <= int(max(len(line), len(other)) * 0.2 + 1e-9):
                lines += [line, other]
                pairs += 1
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in enumerate(lines)], SCHEMA)
    gone = {r.doc_id for r in line_dedup.mark_lines(docs).collect() if r.n_removed}
    assert pairs > 120
    assert sum(i in gone for i in range(1, len(lines), 2)) >= 0.97 * pairs


def test_entries_of_many_lines_keep_their_links(spark):
    rng = random.Random(22)
    lines = []
    for _ in range(60):  # all hold one long phrase, so that its entries are hot
        start, end = prose(rng, 14).replace("\n", " "), prose(rng, 14).replace("\n", " ")
        line = f"{start} a phrase that each of these lines holds {end}"
        at = rng.randrange(len(start))
        lines += [line, line[:at] + "x" + line[at + 1:]]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in enumerate(lines)], SCHEMA)
    gone = {r.doc_id for r in line_dedup.mark_lines(docs).collect() if r.n_removed}
    assert gone == set(range(1, 120, 2))


def test_lines_that_share_one_frequent_entry_are_compared(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SKETCH", 1)
    monkeypatch.setattr(line_dedup, "TILE", 8)
    rng = random.Random(23)
    lines, phrase = [], " ".join(prose(rng, 25).lower().split())
    for _ in range(60):
        start, end = (" ".join(prose(rng, 7).lower().split()) for _ in range(2))
        line = f"{start} {phrase} {end}"
        copy = list(line)
        for at in rng.sample(range(len(copy)), 4):
            copy[at] = "x"
        lines += [line, "".join(copy)]
    sketch = {r.id: set(r.sketch) for r in line_dedup.sketches(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    holders = collections.Counter(x for s in sketch.values() for x in s)
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120) if sketch[a] & sketch[b]]
    edits = duckdb.execute("select levenshtein(unnest(?), unnest(?))", [[lines[a] for a, _ in pairs], [lines[b] for _, b in pairs]]).fetchall()
    links = [(a, b) for (a, b), (n,) in zip(pairs, edits) if n <= int(max(len(lines[a]), len(lines[b])) * 0.2 + 1e-9)]
    assert any(len(sketch[a] & sketch[b]) == 1 and all(holders[x] > 16 for x in sketch[a] & sketch[b]) for a, b in links)
    roots = union_find(range(120), links)
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in enumerate(lines)], SCHEMA)
    gone = {r.doc_id for r in line_dedup.mark_lines(docs).collect() if r.n_removed}
    assert gone == {i for i, root in roots.items() if root != i}


def test_keep_first_judges_rows_not_ids(spark, odd, no_rows):
    rng = random.Random(41)
    rows = [(7, prose(rng, 80), "en", "a", 0) for _ in range(60)]  # different texts of one id
    copied = prose(rng, 80)
    rows += [(3, copied, "en", "a", 0), (None, copied, "en", "b", 0), (9, copied, "en", "a", 0)] + [(7, copied, "en", "a", 0)] * 3
    lone = prose(rng, 80)
    rows += [(None, lone, "en", "a", 0)] * 4 + [(11, prose(rng, 80), "de", "c", 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.withColumns({n: F.lit(1) for n in ("_gone", "_turn", "row_key", "_row_key", "row_goes", "key", "with.dot")})
    left = simhash.keep_first(docs)
    assert left.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect())
    marks = [plain_print(t) for _, t, *_ in rows]
    near = union_find(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 2])
    groups = collections.defaultdict(list)
    for i, root in near.items():
        groups[root].append((rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    assert sorted(x[:2] for x in got) == sorted(min(g)[:2] for g in groups.values())
    assert len(got) >= 62 and (False, 3, copied) in got and (True, 0, lone) in got
    assert simhash.keep_first(no_rows).count() == 0
    # one row for the six texts without differences in words (null, empty, blank; 5, 6 and the row without an id)
    assert sorted(str(r.doc_id) for r in simhash.keep_first(odd).collect()) == sorted(["1", "5", "7", "8", "9"])


def test_dropped_lines_keep_columns_of_any_name(spark):
    line = "one line of more than five words\n"
    docs = spark.createDataFrame([(1, line * 2), (2, line)], "doc_id long, text string")
    docs = docs.withColumns({n: F.lit(n) for n in ("_line_key", "line_key", "line_places", "key", "removed", "with.dot")})
    left = {r.doc_id: r for r in line_dedup.drop_lines(docs).collect()}
    assert left[1].text == line and left[2].text == "" and left[1]._line_key == "_line_key" and left[2].line_key == "line_key"
