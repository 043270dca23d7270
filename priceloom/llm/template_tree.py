"""Line dedup with a log-template tree; DataFrame functions only.

A line's leaf is its number of tokens and its first LEAD tokens, tokens with a digit counting as a variable field. In
leaves that enough documents share, a token that few lines of the leaf have at its place is a variable field too. What is
left of a line is its template; a line whose template keeps fewer than MIN_CONSTANT of its tokens is prose and has none.
Templates that recur in at least MIN_DOCS documents are dropped but for their first occurrence.

Lines of LONG_TOKENS tokens or more whose tokens with a digit are few are templates as they stand, from LONG_DOCS
documents on; lines of fewer than MIN_TOKENS tokens recur by their own text, from MIN_DOCS documents on.

Equal lines are counted before any token is looked at, so a line that a third of all documents hold is one row there;
all counts combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priceloom.llm.common import fresh_name, small, written

LEAD = 3
MIN_TOKENS = 3
MIN_DOCS = 10
MIN_CONSTANT = 0.6
LONG_TOKENS = 20
LONG_DOCS = 2
FIELD = "<*>"
#: Leaves are looked up by broadcast up to this count (a long each), by a shuffled join beyond.
BROADCAST_LEAVES = 1_000_000
#: Recurring templates (hashes and a place) are looked up by broadcast up to this count; beyond, Spark splits the frequent
#: ones of the join.
BROADCAST_TEMPLATES = 200_000

_BLANK = r"[\x20\x09-\x0D]+"
_WITH_DIGIT = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def masked(line: Column) -> Column:
    """Tokens with a digit as variable fields."""
    return F.regexp_replace(line, _WITH_DIGIT, FIELD)


def one_spaced(line: Column) -> Column:
    """One space between tokens and none around them. Most lines are so already, which byte searches tell."""
    odd = [line.contains(blank) for blank in ("  ", "\t", "\x0b", "\x0c", "\r")]
    return F.trim(F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.regexp_replace(line, _BLANK, " ")).otherwise(line))


def _spaced_lines(docs: DataFrame) -> DataFrame:
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return (
        docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(F.length("line") > 0)
        .withColumn("line", one_spaced(F.col("line")))
        .withColumn("n_tokens", spaces + 1)
    )


def _hashes(template: Column) -> list[Column]:
    """128 bits that stand for a template; equal ones count as equal."""
    return [F.xxhash64(template).alias("h1"), F.xxhash64(F.lit(1), template).alias("h2")]


def _line_keys(docs: DataFrame, min_tokens: int, lead: int, min_constant: float, long_tokens: int, min_docs: int, long_docs: int) -> DataFrame:
    """One narrow row a line: its leaf, and the hashes of the line as a template where it is long or very short."""
    line, n_tokens = F.col("line"), F.col("n_tokens")
    short, long = n_tokens < min_tokens, n_tokens >= long_tokens
    template = F.when(short, F.when(line != "", line)).when(long, F.when(line.rlike("[0-9]"), masked(line)).otherwise(line))
    n_constant = F.when(~F.col("template").contains(FIELD), n_tokens).otherwise(F.size(F.array_remove(F.split("template", " ", -1), FIELD)))
    whole = F.col("template").isNotNull() & (short | (n_constant >= min_constant * n_tokens))
    return (
        _spaced_lines(docs)
        .withColumn("template", template)
        .select(
            "doc_id",
            "text_hash",
            "line_no",
            F.when(~short, _leaf(lead)).alias("leaf"),
            *[F.when(whole, h).alias(n) for h, n in zip(_hashes(F.col("template")), ("h1", "h2"))],
            F.when(short, min_docs).otherwise(long_docs).alias("least"),
        )
        .where("leaf IS NOT NULL OR h1 IS NOT NULL")
    )


def _leaf(lead: int) -> Column:
    """Only the leading tokens are masked here; the whole line is where its leaf is shared."""
    return F.xxhash64("n_tokens", masked(F.substring_index("line", " ", lead)))


def recurring_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lead: int = LEAD,
    min_tokens: int = MIN_TOKENS,
    min_docs: int = MIN_DOCS,
    min_constant: float = MIN_CONSTANT,
    broadcast_leaves: int = BROADCAST_LEAVES,
    long_tokens: int = LONG_TOKENS,
    long_docs: int = LONG_DOCS,
) -> DataFrame:
    """(doc_id, text_hash, line_no) of the lines to drop, line numbers from 0; a line that two rules drop comes twice.

    Texts are read twice: once for the leaf and the hashes of each line, once for the lines of shared leaves. Masked lines
    and templates are compared by hashes, so only one row of each variant of a leaf carries its tokens through a shuffle.
    """
    docs = _documents(df, id_col, text_col)
    keys = written(_line_keys(docs, min_tokens, lead, min_constant, long_tokens, min_docs, long_docs), "line-keys")
    leaves = written(
        keys.where("leaf IS NOT NULL").groupBy("leaf", "doc_id").agg(F.lit(1)).groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"),
        "leaves",
    )
    shared = _spaced_lines(docs).where(F.col("n_tokens") >= min_tokens).withColumn("leaf", _leaf(lead)).join(small(leaves, broadcast_leaves), "leaf")
    placed = written(shared.withColumn("masked", masked(F.col("line"))).withColumn("variant", F.xxhash64("masked")).drop("line"), "leaf-lines")
    variants = written(placed.groupBy("leaf", "n_tokens", "variant", "masked").count(), "line-variants")
    tokens = variants.select("leaf", "n_tokens", "variant", "count", F.posexplode(F.split("masked", " ", -1)).alias("place", "token"))
    # A table: all variants of a leaf have the same leading tokens, and Spark splits such keys in joins of tables only.
    constants = written(tokens.where(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("count").alias("lines")).where(F.col("lines") >= min_docs), "constants")
    fields = tokens.join(small(constants, BROADCAST_TEMPLATES), ["leaf", "place", "token"], "left").withColumn("constant", F.col("lines").isNotNull())
    templates = (
        fields.groupBy("leaf", "n_tokens", "variant")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", F.when(F.col("constant"), F.col("token")).otherwise(FIELD).alias("t")))).alias("parts"),
            F.sum(F.col("constant").cast("int")).alias("n_constant"),
        )
        .where(F.col("n_constant") >= min_constant * F.col("n_tokens"))
        .select("leaf", "variant", F.array_join("parts.t", " ").alias("template"))
        .select("leaf", "variant", *_hashes(F.col("template")))
    )
    found = written(
        placed.select("doc_id", "text_hash", "line_no", "leaf", "variant")
        .join(templates, ["leaf", "variant"])
        .select("doc_id", "text_hash", "line_no", "h1", "h2", F.lit(min_docs).alias("least")),
        "template-lines",
    ).union(keys.where("h1 IS NOT NULL").select("doc_id", "text_hash", "line_no", "h1", "h2", "least"))
    place = F.struct("doc_id", "text_hash", "line_no")
    often = written(
        found.groupBy("h1", "h2", "least", "doc_id")
        .agg(F.min(place).alias("first"))
        .groupBy("h1", "h2", "least")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first"))
        .where(F.col("n_docs") >= F.col("least"))
        .drop("n_docs"),
        "often",
    )
    return found.join(small(often, BROADCAST_TEMPLATES), ["h1", "h2", "least"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "line_no")


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of df with its recurring lines cut from the text, and the counts n_lines and n_dropped.

    Null texts stay null (0 lines), empty texts have one line and lose none. Rows that share an id count as one document
    for recurrence; equal rows lose the same lines. Columns named n_lines and n_dropped are replaced, others pass through.
    """
    drops = recurring_lines(df, id_col, text_col, **options)
    key, text_key, gone = (fresh_name(df, x) for x in ("drop_doc", "drop_text", "drop_lines"))
    lists = drops.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key)).agg(F.collect_set("line_no").alias(gone))
    joined = df.join(lists, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(text_key)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    # array_except hashes, so texts of very many lines stay linear; line numbers are distinct.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    kept = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), masks AS (
  SELECT doc_id, line_no, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
         trim(regexp_replace(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '{FIELD}', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS masked
  FROM raw WHERE length(line) > 0
), lines AS (
  SELECT *, string_split(masked, ' ') AS tokens, len(string_split(masked, ' ')) AS n_tokens, list_slice(string_split(masked, ' '), 1, {LEAD}) AS lead FROM masks
), placed AS (
  SELECT * FROM lines WHERE n_tokens >= {MIN_TOKENS} AND (n_tokens, lead) IN (SELECT (n_tokens, lead) FROM lines GROUP BY n_tokens, lead HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
), tokens AS (
  SELECT n_tokens, lead, masked, doc_id, line_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM placed
), constants AS (
  SELECT n_tokens, lead, place, token FROM tokens WHERE token <> '{FIELD}' GROUP BY ALL HAVING count(*) >= {MIN_DOCS}
), templates AS (
  SELECT t.doc_id, t.line_no, t.n_tokens,
         string_agg(CASE WHEN c.token IS NULL THEN '{FIELD}' ELSE t.token END, ' ' ORDER BY t.place) AS template, count(c.token) AS n_constant
  FROM tokens t LEFT JOIN constants c ON t.n_tokens = c.n_tokens AND t.lead = c.lead AND t.place = c.place AND t.token = c.token
  GROUP BY t.doc_id, t.line_no, t.n_tokens
), candidates AS (
  SELECT doc_id, line_no, template, {MIN_DOCS} AS least FROM templates WHERE n_constant >= {MIN_CONSTANT} * n_tokens
  UNION ALL SELECT doc_id, line_no, line, {MIN_DOCS} FROM lines WHERE n_tokens < {MIN_TOKENS} AND line <> ''
  UNION ALL SELECT doc_id, line_no, masked, {LONG_DOCS} FROM lines
  WHERE n_tokens >= {LONG_TOKENS} AND len([t FOR t IN tokens IF t <> '{FIELD}']) >= {MIN_CONSTANT} * n_tokens
), found AS (
  SELECT *, count(DISTINCT doc_id) OVER (PARTITION BY template, least) AS n_docs, row_number() OVER (PARTITION BY template, least ORDER BY doc_id, line_no) AS nth
  FROM candidates
), drops AS (
  SELECT DISTINCT doc_id, line_no FROM found WHERE n_docs >= least AND nth > 1
)
SELECT d.doc_id, CAST(max(len(string_split(d.text, chr(10)))) AS BIGINT) AS n_lines, CAST(count(x.line_no) AS BIGINT) AS n_dropped,
       coalesce(string_agg(CASE WHEN x.line_no IS NULL THEN r.line END, chr(10) ORDER BY r.line_no), '') AS text
FROM documents d LEFT JOIN raw r ON d.doc_id = r.doc_id LEFT JOIN drops x ON r.doc_id = x.doc_id AND r.line_no = x.line_no
GROUP BY d.doc_id
"""
