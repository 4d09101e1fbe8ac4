"""The opN_ queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, langid, licenses, packing, quality, secrets, simhash, substring, toxicity, urlfilter, warc, whitening
from .common import held_out, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents. No SQL: DuckDB has no XXH64."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


@query
def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows removed from all documents."""
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op7_substring"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
flagged AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM flagged),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids. No SQL: it has no tokenizer."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives in segments and read back."""
    path = warc.archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.read_archive(spark, path)).drop("error")


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to FROM r
"""


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdicts of all documents. No SQL: expectation-maximisation is iterative."""
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_quality.*")


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, scanned as two increments against a new ledger, each distinct content once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secrets.findings(docs, secrets.scan_increments(secrets.increments(docs), secrets.new_ledger(spark)))
    spans = F.col("_spans")
    base = [r.kind for r in secrets.BASE]

    def n(kind: str):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(secrets.rendered(F.filter(spans, lambda s: s.kind.isin(base))), 256)
    return out.select("doc_id", *map(n, base), digest.alias("base_sha256"), secrets.rendered(spans).alias("spans"))


def _oracle_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, pos - length(hit) AS start, pos AS stop FROM (
  SELECT doc_id, hit, part, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
    SELECT doc_id, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(parts) AS part, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS parts FROM d)))
  WHERE length(part) >= {least}"""


ORACLES["op4_secrets"] = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\ns AS (" + "\nUNION ALL ".join(_oracle_spans(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secrets.RULES)) + """)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of the ids. No SQL: it has no compressor."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    dictionaries = langid.learn(langid.sample(docs.where(~F.col("held_out")).select("lang", "text")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), dictionaries)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contaminated pairs of documents and benchmark items. No SQL: templates need look-behind over words; tested by brute force."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list.

    The tables have neither fetch times nor lists, so both are derived by rule: a page is fetched
    on day page_id mod 365; of the distinct hosts and their parent domains, those whose MD5 begins
    with 0-3 are listed (block) on day (second digit) * 12, and removed 100 days later where the
    third digit is below 8; those that begin with 4 are allowed from day 0.
    """
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (F.col("page_id") % 365).alias("fetched_at"))
    hosts = captures.select(urlfilter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select(F.explode(F.array("host", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))).alias("domain")).where("domain != ''").distinct()
    h = F.md5("domain")

    def digit(i: int):
        return F.conv(F.substring(h, i, 1), 16, 10).cast("long")

    block = F.struct((digit(2) * 12).alias("listed_at"), F.lit("block").alias("action"))
    remove = F.struct((digit(2) * 12 + 100).alias("listed_at"), F.lit("remove").alias("action"))
    allow = F.struct(F.lit(0).cast("long").alias("listed_at"), F.lit("allow").alias("action"))
    none = F.array().cast("array<struct<listed_at:bigint,action:string>>")
    listed = F.when(digit(1) == 4, F.array(allow)).when((digit(1) < 4) & (digit(3) < 8), F.array(block, remove)).when(digit(1) < 4, F.array(block)).otherwise(none)
    events = domains.select("domain", F.explode(listed).alias("e")).select("domain", "e.*")
    return urlfilter.verdicts(captures, events).select("page_id", "fetched_at", "matched_domain", "list_action", "listed_at", "blocked")


ORACLES["op8_urls"] = r"""
WITH c AS (SELECT page_id, page_id % 365 AS fetched_at, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)', 1), '^\[|\]$|\.+$', '', 'g'), '') AS host FROM pages),
d AS (SELECT DISTINCT domain FROM (SELECT host AS domain FROM c UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c) WHERE domain <> ''),
x AS (SELECT domain, ('0x' || md5(domain)[1])::BIGINT AS a, ('0x' || md5(domain)[2])::BIGINT AS b, ('0x' || md5(domain)[3])::BIGINT AS e FROM d),
iv AS (SELECT domain, 'allow' AS action, 0 AS f, NULL AS t FROM x WHERE a = 4
  UNION ALL SELECT domain, 'block', b * 12, CASE WHEN e < 8 THEN b * 12 + 100 END FROM x WHERE a < 4),
m AS (SELECT c.page_id, iv.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(iv.domain) DESC) AS rn FROM c JOIN iv
  ON (c.host = iv.domain OR NOT contains(c.host, ':') AND ends_with(c.host, '.' || iv.domain)) AND f <= fetched_at AND (t IS NULL OR fetched_at < t))
SELECT c.page_id, c.fetched_at, m.domain AS matched_domain, m.action AS list_action, CAST(m.f AS BIGINT) AS listed_at, coalesce(m.action = 'block', false) AS blocked
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.rn = 1
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the ids. No SQL: models are iterative."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.fit(docs.where(~F.col("held_out")).select("doc_id", "text"), labels)
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings, whitened on up to 16 components; a deviation that no long holds is null. No SQL: it has no eigenvectors."""
    rows = table(spark, sf_dir, "embeddings").where(whitening.usable(F.col("embedding")))
    rows = rows.select("vec_id", whitening.quantised(F.col("embedding")).alias("x"))
    model = whitening.fit(rows)
    out = whitening.by_component(whitening.whiten(rows, model), model)
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of all documents. No SQL: expressions are parsed with a stack."""
    out = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *licenses.digest(F.col("_licenses")))


@query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources from their languages and from each other."""
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM l GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN l USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, l.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + s.v) AS HUGEINT) AS p
  FROM s JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = l.term),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (l.n + 1) // (v.n + v.v) AS HUGEINT) AS q FROM l JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term QUALIFY rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""
