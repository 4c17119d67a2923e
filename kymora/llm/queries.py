"""Registered queries of this package and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymora.llm import ann_forest, bm25_wand, dart_minhash, filter_audit, hybrid_search, license_scan, packing, piece_sampling, secret_links, string_kernel, substring_dedup, token_counts, url_graph
from kymora.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql_url_graph(steps: int = 140) -> str:
    """Rules and both spreads, step by step; masses are whole units, so that both sides are equal."""
    u = url_graph
    fits = " UNION ALL ".join(
        f"SELECT i, {len(h + p)} AS len, '{h + p}' AS rule, '{v}' AS ruled FROM p WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in u.RULES
    )
    parts = []
    for name, seed, src, dst in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{name}0 AS (SELECT host, (({u.UNIT} * {seed}) // pages) * {100 - u.DAMPING} // 100 AS mass FROM seed)")
        parts.append(f"{name}f AS (SELECT {src} AS src, {dst} AS dst, n, sum(n) OVER (PARTITION BY {src}) AS alln FROM edge)")
        for k in range(1, steps):
            moved = f"SELECT f.dst AS host, sum(((s.mass * {u.DAMPING} // 100) * f.n // f.alln)) AS mass FROM {name}{k - 1} s JOIN {name}f f ON f.src = s.host WHERE s.mass > 0 GROUP BY 1"
            parts.append(f"{name}{k} AS MATERIALIZED ({moved})")
        every = " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(steps))
        parts.append(f"{name} AS (SELECT host, sum(mass) AS mass FROM ({every}) GROUP BY 1)")
    link = u.LINK.replace("'", "''")
    return f"""
WITH a AS (SELECT row_number() OVER () AS i, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT i, page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
fit AS (SELECT i, arg_max(rule, struct_pack(len, rule)) AS rule, arg_max(ruled, struct_pack(len, rule)) AS ruled FROM ({fits}) GROUP BY i),
j AS (SELECT p.*, rule, ruled FROM p LEFT JOIN fit USING (i)),
l AS (SELECT DISTINCT i, host AS src, translate(regexp_extract(target, '//([^/?#]*)', 1), '{u.UPPER}', '{u.LOWER}') AS dst
  FROM (SELECT i, host, unnest(regexp_extract_all(html, '{link}', 1)) AS target FROM j WHERE host <> '')),
edge AS (SELECT src, dst, count(*) AS n FROM l WHERE dst <> '' AND src <> dst GROUP BY 1, 2),
seed AS (SELECT host, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM j WHERE host <> '' GROUP BY 1),
{", ".join(parts)}
SELECT page_id, j.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(d.mass, 0) >= {u.LEAST} AND coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(t.mass, 0)::BIGINT AS trust, coalesce(d.mass, 0)::BIGINT AS distrust
FROM j LEFT JOIN t ON t.host = j.host LEFT JOIN d ON d.host = j.host"""


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query()
def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query()
def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.find_secrets(table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    digest = F.sha2(F.encode(secret_links.listed(F.col("base")), "UTF-8"), 256)
    return found.select("doc_id", number("assign"), number("access"), number("hex"), digest.alias("base_sha256"), secret_links.listed(F.col("spans")).alias("spans"))


@query()
def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = string_kernel.fit(docs.filter(~string_kernel.held_out("doc_id")))
    return string_kernel.predict(docs, model).select("doc_id", string_kernel.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query()
def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(sql_url_graph())
def op2_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"))


@query()
def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    back = piece_sampling.decode(piece_sampling.encode(docs, path, keep=("text",)), path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), same.alias("lossless"))


def sql_bm25() -> str:
    from kymora.llm.bm25_wand import DIGITS, K1, B

    return f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_graph.UPPER}', '{url_graph.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
l AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY 1),
g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM l) / (SELECT count(*) FROM documents) AS mean),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (p.tf * ({K1} + 1)::DOUBLE / (p.tf + {K1} * (1 - {B} + {B} * dl::DOUBLE / mean)))), {DIGITS}) AS score
  FROM p q JOIN p USING (term) JOIN f USING (term) JOIN l ON l.doc_id = p.doc_id CROSS JOIN g
  WHERE q.doc_id % 100 = 0 AND p.doc_id <> q.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query(sql_bm25())
def op9_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_wand.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0)


def sql_filter_audit() -> str:
    """Masks per document, then every order as a string of letters against the mask cells."""
    bit = " ".join(f"WHEN '{x}' THEN {1 << i}" for i, x in enumerate(filter_audit.LETTERS))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * capitals > 5 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE instr(filter_order, x) = 0),
s AS (SELECT filter_order, step::INTEGER AS step, letter, CASE letter {bit} END AS bit,
    coalesce((SELECT sum(CASE y {bit} END) FROM (SELECT unnest(string_split(left(filter_order, step - 1), '')) AS y)), 0)::BIGINT AS applied
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step, unnest(string_split(filter_order, '')) AS letter FROM o WHERE length(filter_order) = 5)),
r AS (SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & applied = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & applied = 0), 0)::BIGINT AS toxic_lost
  FROM s CROSS JOIN c GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""


@query(sql_filter_audit())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    places = F.col("places")
    return found.select(
        "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        license_scan.joined(F.col("place_labels")).alias("base_labels"), license_scan.joined(F.col("labels")).alias("labels"), "score",
    )


def sql_hybrid_search() -> str:
    def terms(column: str) -> str:
        return f"regexp_extract_all(translate({column}, '{url_graph.UPPER}', '{url_graph.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH w AS (SELECT row, doc_id, unnest({terms("text")}) AS term FROM (SELECT row_number() OVER () AS row, * FROM documents)),
n AS (SELECT row, count(*) AS n FROM w GROUP BY 1),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
q AS (SELECT DISTINCT item_id, unnest({terms("text")}) AS term FROM benchmark),
p AS (SELECT row, doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY term, docs),
s AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN n USING (row), g GROUP BY 1, 2, 3),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""


@query(sql_hybrid_search())
def op13_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
