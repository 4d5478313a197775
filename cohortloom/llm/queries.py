"""Registered queries of this subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (
    chat, decontaminate, fixity, language, manifest, near_dup, packing, pii, rules, runs, scoring, sharding, tokens,
)
from cohortloom.session import configure, materialise

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

SHARD_BYTES = 128 << 10  # small, so that small tables are split as well


def query(sql: str | None = None):
    """Register ``fn(spark, folder)`` under its own name."""

    def add(fn):
        LLM_QUERIES[fn.__name__] = lambda spark, folder: fn(configure(spark), folder)
        if sql is not None:
            LLM_ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("""
  WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
  s AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS l FROM d),
  g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3),
  k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
  r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY rid),
  m AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
               len(l) AS n_lines FROM s LEFT JOIN r USING (rid)),
  b AS (SELECT *, (n_words < 50)::INTEGER + 2 * (100 * n_repeat_words > 50 * n_words)::INTEGER
               + 4 * (10 * n_symbols > n_words)::INTEGER + 8 * (100 * n_dup_lines > 50 * n_lines)::INTEGER
               + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words))::INTEGER AS failed_bits
        FROM m)
  SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b""")
def op3_quality_ledger(spark, folder):
    return rules.verdict(rules.ledger(table(spark, folder, "documents"), keep=["doc_id"]))


@query()
def op7_pack_in_order(spark, folder):
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("""
  WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
  g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS gram FROM s),
  ks AS (SELECT DISTINCT k FROM g),
  p AS (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
  m AS (SELECT rid, i, p.k, item_id FROM p JOIN g ON g.k = p.k AND g.gram = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
  h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM m) GROUP BY rid),
  t AS (SELECT rid, count(DISTINCT item_id) AS n_items,
               string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
        FROM m GROUP BY rid)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
         sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""")
def op10_fm_index(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])


@query("""
  WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'),
           lambda x: x <> '') AS w FROM documents),
  p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM p),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                           FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) t
            JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
  FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)""")
def op4_lsh_forest(spark, folder):
    return near_dup.near_components(table(spark, folder, "documents"), k=4)


@query()
def op9_kneser_ney(spark, folder):
    docs = table(spark, folder, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs, ~held)
    return language.identify(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op8_transducer_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


@query("""
  WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
             UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
  e AS (SELECT *, regexp_replace(r, '(\\\\|</?s>|\\[/?INST\\])', '\\\\\\1', 'g') AS er,
               regexp_replace(t, '(\\\\|</?s>|\\[/?INST\\])', '\\\\\\1', 'g') AS et FROM c)
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
         CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
         CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id""")
def op2_reply_trees(spark, folder):
    probe = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, "
                      "'</s>[INST] ok [/INST]' AS text FROM range(2)")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    tree = materialise(chat.turn_chains(turns), "tree")
    return chat.digests(chat.format_branches(tree, chat.chosen_branches(chat.leaf_paths(tree))))


@query(f"""
  WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) AS n_bytes,
                    lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT), 60, '0') AS h
             FROM documents),
  p AS (SELECT unnest(range(0, 61)) AS depth),
  b AS (SELECT depth, substr(h, 1, depth) AS shard, sum(n_bytes) AS shard_bytes, count(*) AS n_docs FROM r, p GROUP BY 1, 2),
  m AS (SELECT doc_id, n_bytes, shard, depth, shard_bytes, n_docs, row_number() OVER (PARTITION BY rid ORDER BY depth) AS k
        FROM r JOIN b ON shard = substr(h, 1, depth) WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60)
  SELECT doc_id, shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, CAST(n_bytes AS BIGINT) AS n_bytes,
         CAST(shard_bytes AS BIGINT) AS shard_bytes, n_docs FROM m WHERE k = 1""")
def op1_extendible_hash(spark, folder):
    return sharding.assign(table(spark, folder, "documents"), limit=SHARD_BYTES)


def damaged_pages(pages: DataFrame) -> DataFrame:
    """A replica of all pages in which some, by a hash of their number, are changed, lost or there under another number."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    return pages.where(mark != "bb").select(
        F.when(mark == "cc", -F.col("page_id")).otherwise(F.col("page_id")).alias("page_id"), "url",
        F.when(mark == "aa", F.concat(F.coalesce("html", F.lit("")), F.lit("?"))).otherwise(F.col("html")).alias("html"))


@query("""
  WITH a AS (SELECT page_id AS node, url, html, strlen(coalesce(url, '')) + strlen(coalesce(html, '')) AS n_bytes,
                    substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark FROM pages),
  o AS (SELECT *, coalesce(sum(n_bytes) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_byte
        FROM a),
  b AS (SELECT CASE WHEN mark = 'cc' THEN -node ELSE node END AS node, url,
               CASE WHEN mark = 'aa' THEN coalesce(html, '') || '?' ELSE html END AS html FROM a WHERE mark <> 'bb')
  SELECT coalesce(o.node, b.node) AS node,
         CASE WHEN b.node IS NULL THEN 'missing' WHEN o.node IS NULL THEN 'extra' ELSE 'changed' END AS problem,
         CAST(first_byte AS BIGINT) AS first_byte, CAST(n_bytes AS BIGINT) AS n_bytes,
         CAST(strlen(coalesce(b.url, '')) + strlen(coalesce(b.html, '')) + CASE WHEN b.node IS NULL THEN NULL ELSE 0 END AS BIGINT)
           AS other_bytes
  FROM o FULL JOIN b ON o.node = b.node
  WHERE o.node IS NULL OR b.node IS NULL OR o.url IS DISTINCT FROM b.url OR o.html IS DISTINCT FROM b.html""")
def op6_merkle_audit(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return fixity.audit(pages, damaged_pages(pages), "page_id", ["url", "html"])[0]


@query()
def op5_pseudo_likelihood(spark, folder):
    docs = table(spark, folder, "documents")
    return scoring.score(docs, scoring.fit(docs), ["doc_id"])


# crc32 of decimal text: tab holds the 256 table entries.
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b] || range(8),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"""
CRC = """xor(list_reduce([4294967295] || list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT),
  lambda c, b: xor(c // 256, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


def tree_sql(name: str, levels: int) -> str:
    """CTEs ``name``1, 2, ... over ``name``0 (g, n, i, node), and ``name``s1, ... (g, i, l, r) with the siblings on each level."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, (n + 15) // 16 AS n, i // 16 AS i,
          CASE WHEN n = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY i)) END AS node
          FROM {name}{k} GROUP BY g, n, i // 16)""")
        out.append(f"""{name}s{k} AS MATERIALIZED (SELECT a.g, a.i, a.n,
          coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
          coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
          FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 16 = b.i // 16 GROUP BY a.g, a.i, a.n)""")
    return ",\n".join(out)


def manifest_sql(levels: int = 5, crowns: int = 3) -> str:
    """The whole manifest for at most 16 ** levels documents a source and 16 ** crowns sources."""
    framed = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    h = lambda text: "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [("t", k, f"d.i // {16 ** k}", "d.g") for k in range(levels)] + [("u", k, f"d.g // {16 ** k}", "0") for k in range(crowns)]
    joins = " ".join(f"JOIN {t}s{k} {t}x{k} ON {t}x{k}.i = {i} AND {t}x{k}.g = {g}" for t, k, i, g in steps)
    proof = " || ".join(f"{t}x{k}.l || {t}x{k}.r" for t, k, _, _ in steps)
    folds, before = [], "f0"
    for j, (t, k, _, _) in enumerate(steps):
        folds.append(f"f{j + 1} AS (SELECT * REPLACE (CASE WHEN n_{t}{k} = 1 THEN h ELSE sha256(l_{t}{k} || h || r_{t}{k}) END AS h) "
                     f"FROM {before})")
        before = f"f{j + 1}"
    beside = ", ".join(f"{t}x{k}.n AS n_{t}{k}, {t}x{k}.l AS l_{t}{k}, {t}x{k}.r AS r_{t}{k}" for t, k, _, _ in steps)
    return f"""
  WITH {CRC_TABLE},
  d AS MATERIALIZED (SELECT doc_id, leaf, offered, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM (SELECT doc_id, source, {h('text')} AS leaf,
                 CASE WHEN {CRC.format('doc_id')} % 5 = 0 THEN {h(lower)} END AS offered FROM documents, crc_table)),
  t0 AS (SELECT g, n, i, leaf AS node FROM d), {tree_sql('t', levels)},
  u0 AS (SELECT 0 AS g, (SELECT count(*) FROM t{levels}) AS n, g AS i, node FROM t{levels}), {tree_sql('u', crowns)},
  f0 AS (SELECT d.doc_id, d.leaf, u0.node AS subroot, u{crowns}.node AS root, sha256({proof}) AS proof_sha256,
                coalesce(d.offered, d.leaf) AS h, {beside}
         FROM d JOIN u0 ON u0.i = d.g CROSS JOIN u{crowns} {joins}),
  {", ".join(folds)}
  SELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM {before}"""


@query(manifest_sql())
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = manifest.leaf_hash(*[lowered if f == "text" else F.col(f) for f in fields])
    offered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, tampered)
    return manifest.manifest(docs, "source", "doc_id", fields, offered)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where one document in ten, by the checksum of its id, goes on in a period from some word on."""
    def bind(value, body):  # so that a lambda does not compute the value anew for every element
        return F.element_at(F.transform(F.array(value), body), 1)

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def tail(w):
        n = F.greatest(F.size(w), F.lit(1))
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return bind(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(
            w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, x["a"] + (i - x["a"]) % x["p"]))), " "))

    return docs.select("doc_id", F.when(h % 10 == 0, bind(split, tail)).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark, folder):
    found = runs.find_runs(with_periodic_tails(table(spark, folder, "documents")))
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast(runs.RUN), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), sha(listed).alias("runs_sha256"),
                       sha(F.col("collapsed")).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period",
                      F.floor(F.expr("1000 * b.length div b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query()
def op11_semi_markov_pii(spark, folder):
    docs = table(spark, folder, "documents")
    found = pii.find(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))
