"""One query for each corpus operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import linkgraph
from cladeframe.llm.common import Scratch, crc32_mod, read_table
from cladeframe.llm.epsilongrid import near_vectors
from cladeframe.llm.linkgraph import judge_urls
from cladeframe.llm.matroska import media_from_texts
from cladeframe.llm.minhash import near_duplicates
from cladeframe.llm.packing import pack
from cladeframe.llm.quality import quality_scores
from cladeframe.llm.substrings import CUT, substring_dedup
from cladeframe.llm.tokens import piece_digests, token_counts
from cladeframe.llm.toxicity import toxicity_scores


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with repeated passages removed: cleaned text, removed spans and characters, offsets of the original."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, Scratch(spark))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are at least 80 percent similar, confirmed on full sets."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), Scratch(spark), width=4, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; null and empty texts are their end token."""
    return pack(read_table(spark, sf_dir, "documents"), Scratch(spark), keep_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the grammar, learned outside the held-out fifth; empty and null texts have no arcs."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = crc32_mod("doc_id", 5) == 0
    return toxicity_scores(docs, labels, Scratch(spark), ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests; a null text is empty."""
    return piece_digests(read_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents; a null text is empty."""
    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.93; unsound vectors are alone."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), Scratch(spark))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media and read back, as digests and figures; a null text is empty."""
    return media_from_texts(read_table(spark, sf_dir, "documents"), keep_media=False)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of all pages; a null url has neither host nor path and is allowed."""
    return judge_urls(read_table(spark, sf_dir, "pages"), Scratch(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the discriminant, learned outside the held-out third; texts without words are one point."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = crc32_mod("doc_id", 3) == 1
    return quality_scores(docs, labels, ~held).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_minhash_near_dedup, op3_packing, op4_toxicity, op5_sentencepiece, op6_token_counts,
    op7_embedding_near_dedup, op8_media_columns, op9_url_filters, op10_quality_classifier)}

# -- DuckDB SQL --------------------------------------------------------------

_FILLER = r" \t\r\n.,;:!?"
_OP1_SQL = rf"""
WITH chunks AS (
  SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, '[^{_FILLER}]*[{_FILLER}]+|[^{_FILLER}]+') AS cs FROM documents)
), ended AS (
  SELECT *, CASE WHEN regexp_matches(c, '[\n.,;:!?]') OR (core <> '' AND (strlen(core) + CASE WHEN mark < 128 THEN mark ELSE 128 + mark % 64 END) % {CUT} = 0) THEN 1 ELSE 0 END AS ends
  FROM (SELECT *, unicode(translate(right(core, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS mark
        FROM (SELECT *, regexp_extract(c, '^[^{_FILLER}]*') AS core FROM chunks))
), numbered AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended
), parts AS (
  SELECT doc_id, CAST(pos AS BIGINT) AS pos, string_agg(c, '' ORDER BY i) AS u FROM numbered GROUP BY ALL
), units AS (
  SELECT doc_id, pos, length(u) AS len, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS words, n FROM (
    SELECT *, trim(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g')) AS n FROM parts)
), summed AS (
  SELECT *, CAST(sum(words) OVER w AS BIGINT) AS upto, CAST(sum(len) OVER w AS BIGINT) AS stop FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), windowed AS (
  SELECT a.doc_id, a.pos AS first, b.pos AS last FROM summed a ASOF JOIN summed b ON a.doc_id = b.doc_id AND a.upto - a.words + 20 <= b.upto WHERE a.words > 0
  UNION
  SELECT b.doc_id, a.pos, b.pos FROM summed b ASOF JOIN summed a ON a.doc_id = b.doc_id AND b.upto - 20 >= a.upto - a.words WHERE b.words > 0
), listed AS (
  SELECT doc_id, list(n ORDER BY pos) AS ns FROM units GROUP BY doc_id
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY array_to_string(ns[first + 1:last + 1], chr(1)) ORDER BY w.doc_id, first) AS occurrence
  FROM windowed w JOIN listed USING (doc_id)
), later AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranked WHERE occurrence > 1
), islands AS (
  SELECT *, sum(CASE WHEN first <= before + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY first, last) AS island FROM later
), spans AS (
  SELECT doc_id, min(first) AS first, max(last) AS last FROM islands GROUP BY doc_id, island
), placed AS (
  SELECT s.doc_id, a.stop - a.len AS start, b.stop AS stop FROM spans s
  JOIN summed a ON a.doc_id = s.doc_id AND a.pos = s.first JOIN summed b ON b.doc_id = s.doc_id AND b.pos = s.last
), lists AS (
  SELECT doc_id, count(*) AS n, sum(stop - start)::BIGINT AS chars, list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops,
         string_agg(start || '+' || (stop - start), ';' ORDER BY start) AS spans FROM placed GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i:
         substring(text, coalesce(stops[i], 0) + 1, coalesce(starts[i + 1], length(text)) - coalesce(stops[i], 0))), '') END AS text,
       coalesce(n, 0) AS n_removed, coalesce(chars, 0) AS removed_chars, coalesce(l.spans, '') AS spans
FROM documents d LEFT JOIN lists l ON l.doc_id = d.doc_id
"""

_COMPONENTS_SQL = """, reach(node, low) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b
), component AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
"""

_OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), half AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b
  WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)
), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half)
""" + _COMPONENTS_SQL + """
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN component c ON c.node = d.doc_id
"""

_OP7_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
)
""" + _COMPONENTS_SQL + """
, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(g.n, 0) AS n_links, coalesce(c.low, v.vec_id) AS component_id, coalesce(c.low, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN degree g ON g.a = v.vec_id LEFT JOIN component c ON c.node = v.vec_id
"""


def _op9_sql() -> str:
    rules = sorted(linkgraph.RULES, key=lambda r: -len(r[0] + r[1]))

    def case(pick) -> str:
        arms = " ".join(f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}') THEN '{pick((h, p, v))}'"
                        for h, p, v in rules)
        return f"CASE {arms} END"

    link = linkgraph.LINK.replace("'", "''")
    d, rounds = linkgraph.DAMPING, linkgraph.ROUNDS
    steps = ",\n".join(
        f"r{k} AS (SELECT kind, host, sum(r) AS r FROM (SELECT s.kind, s.goes AS host, {d} * s.p * q.r AS r FROM steps s JOIN r{k - 1} q "
        f"ON q.kind = s.kind AND q.host = s.host UNION ALL SELECT kind, host, {1 - d} * r FROM r0) GROUP BY ALL)" for k in range(1, rounds + 1))
    return rf"""
WITH after AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after
), ruled AS (
  SELECT page_id, html, host, path, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled FROM named
), linked AS (
  SELECT host AS src, dst, count(*) AS n FROM (
    SELECT host, page_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM named) GROUP BY ALL
), hosts AS (SELECT host FROM named UNION SELECT dst FROM linked
), above AS (
  SELECT * FROM (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM hosts) WHERE contains(dst, '.') AND src <> dst
), edges AS (
  SELECT src, dst, sum(n) AS n FROM (SELECT * FROM linked UNION ALL SELECT src, dst, 1 FROM above UNION ALL SELECT dst, src, 1 FROM above)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL
), steps AS (
  SELECT 0 AS kind, src AS host, dst AS goes, n / sum(n) OVER (PARTITION BY src) AS p FROM edges
  UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges
), seeds AS (
  SELECT host, 0 AS kind, count(*) FILTER (ruled = 'allow') AS w FROM ruled WHERE host <> '' GROUP BY host
  UNION ALL SELECT host, 1, count(*) FILTER (ruled = 'block') FROM ruled WHERE host <> '' GROUP BY host
), r0 AS (SELECT kind, host, w / sum(w) OVER (PARTITION BY kind) AS r FROM seeds WHERE w > 0
), {steps},
scores AS (SELECT host, sum(CASE WHEN kind = 0 THEN r ELSE 0 END) AS trust, sum(CASE WHEN kind = 1 THEN r ELSE 0 END) AS distrust FROM r{rounds} GROUP BY host)
SELECT p.page_id, p.host, p.path, p.rule,
       coalesce(p.ruled, CASE WHEN s.distrust > s.trust * {1 + linkgraph.MARGIN!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled p LEFT JOIN scores s ON s.host = p.host
"""


ORACLE_SQL = {"op1_substring_dedup": _OP1_SQL, "op2_minhash_near_dedup": _OP2_SQL,
              "op7_embedding_near_dedup": _OP7_SQL, "op9_url_filters": _op9_sql()}
