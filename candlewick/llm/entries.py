"""The operators' queries, each over its whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm import chat_format, decontamination, lexical, lm_score, merkle, ngram_join, packing, quality_rules, secrets, token_files, toxicity, url_rules, warc
from candlewick.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, a row per piece; null and empty texts have the end token alone."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document: counts, digest of the base spans, and all spans; a null text is empty."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


#: The rules of the url query: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page; a null url, or one without ://, has an empty host and path."""
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every whole document and the verdict of the list learned from labels; a null text has no words."""
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn_from(docs, _table(spark, sf_dir, "labels")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every whole document against the benchmark; a null text has no words."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every whole document, learned from labels outside the held-out fold; empty texts have a score too."""
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every whole document by links of similar shingle sets; texts without words stand alone."""
    return ngram_join.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, a row per record; a null html is empty."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every whole document, learned from the training fold; a null text is the end token."""
    return lm_score.report(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k and 2 k + 1 as chosen and rejected: digests of prompt and completions, and the learned spans."""
    turns = _table(spark, sf_dir, "conversations")
    df = chat_format.preferences(turns, chat_format.neighbours(turns))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    spans = [chat_format.listed(f"{c}_learned").alias(f"{c}_learned") for c in ("chosen", "rejected")]
    return df.select("pair_id", "n_prompt", "n_chosen", "n_rejected", *digests, *spans)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's 50 best documents; null texts are never found."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and audit of every row of documents; rows whose id's checksum 7 divides are found with one character too many."""
    docs = _table(spark, sf_dir, "documents")
    damaged = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    rows = merkle.of_documents(docs, damaged=damaged, found={"n_chars": F.try_add(docs["n_chars"], F.lit(1))}).audit()
    return rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document's ids written to token files and read back; a null or empty text has the end id alone."""
    path = scratch_path(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op8_url_filters": op8_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_warc": op6_warc,
    "op7_packing": op7_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_lm_score": op10_lm_score,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle": op12_merkle,
    "op13_token_files": op13_token_files,
}

#: Words of a text for decontamination: A-Z lower-cased, runs of digits, letters and all that isn't ASCII.
_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES: dict[str, str] = {
    "op3_ngram_join": r"""
        WITH RECURSIVE d AS (
          SELECT row_number() OVER () AS rid, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
          FROM documents),
        s AS (SELECT DISTINCT rid, array_to_string(ws[i : i + m - 1], ' ') AS shingle
              FROM (SELECT rid, ws, least(len(ws), 5) AS m, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM d WHERE len(ws) > 0)),
        n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
        overlap AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid <> b.rid GROUP BY a.rid, b.rid),
        link AS (SELECT a, b FROM overlap JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT reach.rid, link.b FROM reach JOIN link ON link.a = reach.other),
        comp AS (SELECT reach.rid, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.rid = reach.other GROUP BY reach.rid)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN comp USING (rid) LEFT JOIN n USING (rid)""",
    "op4_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, """ + _SQL_WORDS + r""" AS ws FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, """ + _SQL_WORDS + r""" AS ws FROM benchmark WHERE item_id IS NOT NULL),
        bn AS (SELECT item, ws, least(len(ws), 13) AS n FROM b WHERE len(ws) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT item, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bn)),
        lens AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
        hit AS (SELECT rid, i, n, item FROM dw JOIN win USING (w, n)),
        items AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY rid),
        pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hit)) GROUP BY rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN items USING (rid) LEFT JOIN pos USING (rid)""",
    "op5_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(turn, -1) AS turn, replace(replace(coalesce(role, ''), '<\', '<\\'), '<|', '<\|') AS role,
                          replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        lone AS (SELECT pair_id, min(turn) AS cut FROM (SELECT pair_id, turn, role, text FROM t GROUP BY ALL HAVING count(*) = 1) GROUP BY pair_id),
        part AS (SELECT t.*, CASE WHEN cut IS NULL OR turn < cut THEN 'p' WHEN side = 0 THEN 'c' ELSE 'r' END AS kind FROM t LEFT JOIN lone USING (pair_id)),
        turns AS (SELECT DISTINCT pair_id, kind, turn, role, text FROM part),
        shown AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM turns),
        placed AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY pair_id, kind ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM shown),
        whole AS (SELECT pair_id, kind, count(*) AS n, string_agg(s, '' ORDER BY turn, role, text) AS s,
                         coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(pos + 14 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(s) - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, role, text), '') AS spans
                  FROM placed GROUP BY pair_id, kind)
        SELECT i.pair_id, coalesce(p.n, 0) AS n_prompt, coalesce(c.n, 0) AS n_chosen, coalesce(r.n, 0) AS n_rejected,
               sha256(coalesce(p.s, '')) AS prompt_sha256, sha256(coalesce(c.s, '')) AS chosen_sha256, sha256(coalesce(r.s, '')) AS rejected_sha256,
               coalesce(c.spans, '') AS chosen_learned, coalesce(r.spans, '') AS rejected_learned
        FROM (SELECT DISTINCT pair_id FROM t) i
        LEFT JOIN whole p ON p.pair_id = i.pair_id AND p.kind = 'p' LEFT JOIN whole c ON c.pair_id = i.pair_id AND c.kind = 'c' LEFT JOIN whole r ON r.pair_id = i.pair_id AND r.kind = 'r'""",
    "op6_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
        SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
        FROM f""",
    "op8_url_filters": r"""
        WITH u AS (
          SELECT page_id,
                 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        rules(verdict, r_host, r_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
        numbered AS (SELECT row_number() OVER () AS n, * FROM u)
        SELECT page_id, host, path,
               arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
               coalesce(arg_max(verdict, length(r_host || r_path)), 'allow') AS verdict
        FROM numbered LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        GROUP BY n, page_id, host, path""",
    "op11_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, """ + _SQL_WORDS + r""" AS ws FROM documents),
        c AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS length FROM d),
        occurrence AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY rid, term),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM occurrence GROUP BY term), c),
        item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(ws) AS term FROM (SELECT item_id, """ + _SQL_WORDS + r""" AS ws FROM benchmark))),
        scored AS (
          SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ws) * n_docs) // length)))) AS BIGINT) AS score
          FROM item JOIN occurrence USING (term) JOIN weight USING (term) JOIN d USING (rid), c GROUP BY item_id, rid, doc_id)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50""",
    "op12_merkle": r"""
        WITH RECURSIVE d AS (
          SELECT *, sha256(CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(CAST(source AS VARCHAR))) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(CAST(lang AS VARCHAR))) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(CAST(text AS VARCHAR))) || ':' || text END) AS leaf,
                 row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
          FROM (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS rid FROM documents)),
        t(lang, level, pos, h, n) AS (
          SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM d
          UNION ALL
          SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
        sub AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM t WHERE n = 1),
        u(level, pos, h, n) AS (
          SELECT 0, pos, subroot, count(*) OVER () FROM sub
          UNION ALL
          SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
        steps AS (
          SELECT rid, t.level, 0 AS upper, d.pos // CAST(pow(2, t.level) AS BIGINT) AS own, t.n, d.lang FROM d JOIN (SELECT DISTINCT lang, level, n FROM t WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM d.lang
          UNION ALL
          SELECT rid, u.level, 1, sub.pos // CAST(pow(2, u.level) AS BIGINT), u.n, d.lang FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang, (SELECT DISTINCT level, n FROM u WHERE n > 1) u),
        path AS (
          SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY upper, s.level) AS step, s.own % 2 AS place, coalesce(t.h, u.h, '') AS h
          FROM steps s LEFT JOIN t ON s.upper = 0 AND t.lang IS NOT DISTINCT FROM s.lang AND t.level = s.level AND t.pos = xor(s.own, 1)
                       LEFT JOIN u ON s.upper = 1 AND u.level = s.level AND u.pos = xor(s.own, 1)),
        proof AS (SELECT rid, string_agg(h, '' ORDER BY step) AS h FROM path GROUP BY rid),
        seen AS (SELECT rid, sha256(CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(CAST(source AS VARCHAR))) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(CAST(lang AS VARCHAR))) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END || CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(CAST(text AS VARCHAR))) || ':' || text END) AS h FROM (SELECT * REPLACE (CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars) FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc FROM d))),
        fold(rid, step, h) AS (
          SELECT rid, 1, h FROM seen
          UNION ALL
          SELECT f.rid, f.step + 1, sha256(CASE WHEN place = 1 THEN p.h || f.h ELSE f.h || p.h END) FROM fold f JOIN path p ON p.rid = f.rid AND p.step = f.step),
        done AS (SELECT rid, arg_max(h, step) AS folded_root FROM fold GROUP BY rid)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof.h, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM d JOIN sub ON sub.lang IS NOT DISTINCT FROM d.lang JOIN done USING (rid) LEFT JOIN proof USING (rid), (SELECT h AS root FROM u WHERE n = 1)""",
}
