"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm.shared import table


def op1_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.outliers import robust_outliers

    return robust_outliers(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.warc import archive_round_trip

    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.token_store import token_round_trip

    return token_round_trip(spark, table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.language_model import score_by_fold

    return score_by_fold(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.line_dedup import mark_lines

    return mark_lines(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from basketry.llm.lexical_search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (op1_outliers, op2_quality, op3_warc, op4_bpe, op5_token_store, op6_language_model, op7_line_dedup,
             op8_toxicity, op9_simhash, op10_decontaminate, op11_collocations, op12_html_text, op13_lexical_search)
    return {f.__name__: f for f in known}


#: Each page's payload; of equal ones that of the largest page_id is the response. Base32 takes five bits a letter.
OP3_SQL = """WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, CAST(CAST(from_hex(sha1(payload)) AS BIT) AS VARCHAR) AS bits,
  max(page_id) OVER (PARTITION BY payload) AS latest FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
    + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
    + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT NULL AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM d"""


#: All phrases of up to four words, their lowest cut, and what a longer candidate covers.
OP11_SQL = r"""WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT doc, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
u AS MATERIALIZED (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM q),
g AS (SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM u, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE i + size - 1 <= len(words)),
f AS MATERIALIZED (SELECT lang, CAST(size AS BIGINT) AS size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(words)) AS n FROM q GROUP BY lang),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
k AS (SELECT c.*, unnest(range(1, size)) AS cut FROM c),
s AS (SELECT k.lang, k.size, k.phrase, k.a, k.words, k.cut, x.a AS l, y.a AS r,
    CAST((2000000::HUGEINT * k.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.words[1:k.cut], ' ')
    JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.words[k.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
sub AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, a AS longer
  FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < size AND i + m - 1 <= size),
most AS (SELECT lang, phrase, max(longer) AS longer FROM sub GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN most USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept JOIN totals USING (lang)
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER w <= 2000"""

#: Impacts and weights of all terms of the items.
OP13_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS doc FROM documents),
n AS (SELECT doc, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS size FROM n),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT item_id, row_number() OVER () AS item, unnest(list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT item_id, item, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN df USING (term), t),
s AS (SELECT item_id, item, doc, n.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // size)))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN n USING (doc), t GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op11_collocations": OP11_SQL, "op13_lexical_search": OP13_SQL}
