"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import centroids, codebooks, decontaminate, exact_dedup, html_extract, langid, licenses, mixing, ngram_join, passages, substrings, tokenfile, warc
from weft.llm.common import scratch, table

WORDS_SQL = r"[^\x20\x09-\x0D]+"


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER w, 0.0))
            / ((SELECT sum(weight) FROM ranked) - coalesce(sum(weight) OVER w, 0.0)) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank
  FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(cap, (SELECT min_by(level, rank) FROM levels WHERE level * weight <= cap) * weight) AS target
  FROM levels),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(least(budget % source_size - before, size), 0) END AS BIGINT) AS taken
FROM placed
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write(pages, folder)
    return warc.read(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id,
             CAST(CAST(unhex(digest) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, CAST(1 + 5 * i AS INT), 5) AS INT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


OP7_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS_SQL}') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OP10_WORDS = r"string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
OP10_SQL = f"""
WITH templates(license, body) AS (VALUES {", ".join(f"({_literal(n)}, {_literal(t)})" for n, t in licenses.TEMPLATES)}),
tw AS (SELECT license, {_OP10_WORDS.format("body")} AS w FROM templates),
want AS (SELECT DISTINCT license, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS sh
         FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
known AS (SELECT license, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS m FROM want GROUP BY license),
dw AS (SELECT doc_id, {_OP10_WORDS.format("text")} AS w FROM documents),
shingles AS (SELECT doc_id, i - 1 AS pos, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS sh
             FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hits AS (SELECT s.doc_id, k.license, k.n, s.sh, unnest([s.pos // k.m * k.m, s.pos // k.m * k.m - k.m]) AS first_word
         FROM shingles s JOIN want USING (sh) JOIN known k ON k.license = want.license),
windows AS (SELECT doc_id, license, first_word, count(DISTINCT sh) / CAST(any_value(n) AS DOUBLE) AS share
            FROM hits WHERE first_word >= 0 GROUP BY ALL)
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, min(first_word) AS first_word
FROM windows WHERE share >= {licenses.CONTAINMENT} GROUP BY doc_id, license
"""


def op11_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings"))
    full = codebooks.with_label_error(coded)
    return full.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "ids")
    manifest = tokenfile.write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, centres = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.hashes(clustered, centres).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_INTEGERS = """SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_SQUARED = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_FLOOR = "({s} - ((({s}) % {n}) + {n}) % {n}) // {n}"


def _op11_sql(rounds: int = 2) -> str:
    """Rounds written out: parts are matched with all entries of their codebook, then entries are averaged."""
    steps = [f"""q AS MATERIALIZED ({_INTEGERS}),
parts AS MATERIALIZED (SELECT r, vec_id, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM q, range(16) t(p)),
seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM q ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT p, k, v FROM parts JOIN seeds USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, min({{'d': {_SQUARED.format("parts.v", f"b{i}.v")}, 'k': k}}) AS m FROM parts JOIN b{i} USING (p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT p, k, c, sum(x) AS s, count(*) AS n FROM (SELECT p, m.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS c FROM parts JOIN a{i} USING (r, p)) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(any_value(t.v), any_value(b.v)) AS v FROM b{i} b LEFT JOIN
  (SELECT p, k, list(CAST({_FLOOR.format(s="s", n="n")} AS BIGINT) ORDER BY c) AS v FROM s{i} GROUP BY p, k) t ON t.p = b.p AND t.k = b.k GROUP BY b.p, b.k)""")
    steps.append(f"""coded AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, c)) FROM (SELECT p, k, unnest(v) AS x, generate_subscripts(v, 1) AS c FROM b{rounds})) AS codebooks_sha256
FROM coded JOIN q USING (r)"""


def _op13_sql(rounds: int = 5) -> str:
    steps = [f"""q AS MATERIALIZED (SELECT * FROM ({_INTEGERS}) WHERE len(x) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, x AS v FROM q ORDER BY sha256('2:' || vec_id) LIMIT 40)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min({{'d': {_SQUARED.format("x", "v")}, 'k': k}}) AS m FROM q, c{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT k, c, sum(x) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(x) AS x, generate_subscripts(x, 1) AS c FROM q JOIN a{i} USING (r)) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT b.k, coalesce(any_value(t.v), any_value(b.v)) AS v FROM c{i} b LEFT JOIN
  (SELECT k, list(CAST({_FLOOR.format(s="s", n="n")} AS BIGINT) ORDER BY c) AS v FROM s{i} GROUP BY k) t ON t.k = b.k GROUP BY b.k)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM q JOIN a{rounds} USING (r) JOIN c{rounds} c ON c.k = m.k"""


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_langid": op5_langid,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_join": op7_ngram_join,
    "op8_html_extract": op8_html_extract,
    "op9_passages": op9_passages,
    "op10_licenses": op10_licenses,
    "op11_codebooks": op11_codebooks,
    "op12_token_files": op12_token_files,
    "op13_centroids": op13_centroids,
}

ORACLES = {
    "op2_mixing": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op7_ngram_join": OP7_SQL,
    "op10_licenses": OP10_SQL,
    "op11_codebooks": _op11_sql(),
    "op13_centroids": _op13_sql(),
}
