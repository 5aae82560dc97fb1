"""Registered queries of this subpackage, thin over its operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import blob_ledger, chat_format, collocations, crf_lines, decontaminate, language_id, nbsvm, pii_bootstrap, sentencepiece_codec, simhash_segments, structure_repair, substring_dedup, url_vocab
from curatrix.llm.common import cut_lineage, read_table

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of 1 needed to predict 1.
QUALITY_AT = 0.7

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql.strip()
        return build

    return register


def joined_spans(spans: Column) -> Column:
    """kind:start:end of ordered span structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def n_of(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, (kind,))).cast("long")


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_texts(docs, "text", SENTENCEPIECE_MODEL).drop("text")


#: A conversation whose texts look like control strings.
TRAP = "SELECT -7L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role), '</s>[INST] ok [/INST]' AS text"


@query(
    r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), placed AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    24 + length(regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n') || chr(10) || text,
      '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|system\|>|\|user\|>|\|assistant\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')) - 1 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM summed GROUP BY conv_id
"""
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    turns = read_table(spark, sf_dir, "conversations").select(*columns).unionByName(spark.sql(TRAP).select(*columns))
    rows = chat_format.expand(turns, *columns)
    back = F.transform(chat_format.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = rows.select(
        "conv_id", "example_no", F.col("target_turn").isNotNull().alias("trained"), F.length("formatted").alias("chars"),
        chat_format.trained_text(rows).alias("loss"), F.when(F.col("closing"), back).alias("turns"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "loss"))), lambda x: x["loss"]), "")
    each = read.groupBy("conv_id").agg(
        F.flatten(F.collect_list("turns")).alias("turns"),
        loss.alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count_if("trained").alias("n_examples"),
    )
    return each.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


@query()
def op3_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labels = read_table(spark, sf_dir, "labels").filter(~held_out)
    model = nbsvm.train(docs, labels, "doc_id", "text", "quality")
    scored = nbsvm.score(docs, "text", model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


@query(
    r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM worded WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1
), covered AS (
  SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later) GROUP BY doc_id
), kept AS (
  SELECT doc_id, w, coalesce(js, []) AS js FROM worded LEFT JOIN covered USING (doc_id)
), marked AS (
  SELECT doc_id, len(w) AS n_words, len(js) AS n_removed, w, list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(js, j))) AS stay
  FROM kept
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(list_transform(stay, lambda j: w[j]), ' '), '')) AS kept_sha256
FROM marked
"""
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), "doc_id", "text", length=20)
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op5_crf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = crf_lines.train(docs, labels, "doc_id", "text", "quality")
    return crf_lines.judge(docs, "doc_id", "text", model)


BASE_SECRETS = ("assign", "access", "hex")


@query(
    r"""
WITH marked AS (
  SELECT doc_id, k.place, k.kind, k.least, k.own, k.pattern, coalesce(text, '') AS text
  FROM documents, (VALUES
    (0, 'assign', 6, true, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'access', 20, true, '()(AKIA[A-Z0-9]+)'),
    (2, 'hex', 24, true, '()([0-9a-f]+)'),
    (3, 'jwt', 30, false, '(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)'),
    (4, 'pem', 0, false, '()(-----BEGIN [A-Z ]*PRIVATE KEY-----)')
  ) AS k(place, kind, least, own, pattern)
), found AS (
  SELECT doc_id, place, kind, least, own, regexp_extract_all(text, pattern, 0) AS whole,
    regexp_extract_all(text, pattern, 2) AS inner_text, CASE kind WHEN 'jwt' THEN regexp_extract_all(text, pattern, 1) END AS ahead, regexp_split_to_array(text, pattern) AS gaps
  FROM marked
), placed AS (
  SELECT doc_id, place, kind, own, least, whole[i][1 + coalesce(length(ahead[i]), 0):] AS m, inner_text[i] AS inside, coalesce(length(ahead[i]), 0)
    + list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in whole[1:i - 1]]), 0) AS s
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)
), spans AS (
  SELECT doc_id, place, kind, own, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM placed WHERE length(inside) >= least
), per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (own), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CASE WHEN EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND coalesce(e.text, '') = coalesce(d.text, '')) THEN 0 ELSE 5 END AS n_later_pairs
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""
)
def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # Two scans, as of a repository at two times: the second reads only what the ledger of the first lacks.
    early = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    before = cut_lineage(blob_ledger.scan_unseen(docs.filter(early), "text"))
    later = cut_lineage(blob_ledger.scan_unseen(docs.filter(~early), "text", before))
    found = blob_ledger.findings(docs.withColumn("blob", blob_ledger.blob_id(F.col("text"))), "text", before.unionByName(later))
    pairs = later.groupBy("blob").agg(F.count(F.lit(1)).alias("n_later_pairs"))
    spans = F.col("found_spans")
    return found.join(pairs, "blob", "left").select(
        "doc_id",
        F.coalesce("n_later_pairs", F.lit(0)).alias("n_later_pairs"),
        *(n_of(spans, k).alias(f"n_{k}") for k in BASE_SECRETS),
        F.sha2(joined_spans(of_kinds(spans, BASE_SECRETS)), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )


def _term_sql(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


_SOFT_SQL = " + ".join(f"CASE WHEN {_term_sql(t)} THEN {w} ELSE 0 END" for t, w in url_vocab.SOFT.items())
_SOFT_HITS_SQL = " + ".join(f"CASE WHEN {_term_sql(t)} THEN 1 ELSE 0 END" for t in url_vocab.SOFT)


@query(
    rf"""
WITH parted AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fits AS (
  SELECT page_id, arg_max(struct_pack(rule := h || p, verdict := v), length(h || p)) AS fit
  FROM (SELECT DISTINCT page_id, host, path FROM parted), (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(h, p, v)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), judged AS (
  SELECT *, {" OR ".join(_term_sql(t) for t in url_vocab.STRICT)} AS firm, {_SOFT_SQL} AS soft_weight, {_SOFT_HITS_SQL} AS soft_hits FROM parted
)
SELECT page_id, host, path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN firm OR (soft_hits >= {url_vocab.LEAST_SOFT} AND soft_weight >= {url_vocab.LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  soft_weight::INT AS soft_weight
FROM judged LEFT JOIN fits USING (page_id)
"""
)
def op7_url_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_vocab.filter_urls(pages, "page_id", "url").select("page_id", "host", "path", "rule", "verdict", "soft_weight")


@query()
def op8_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    made = simhash_segments.simhash_components(docs, "doc_id", "text", shingle=3, distance=3)
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BASE_PERSONAL = ("email", "ip", "card", "phone")


_WORDS_OF = r"regexp_extract_all(lower(regexp_replace({}, '[0-9]', '0', 'g')), '[^\x20\x09-\x0D]+')"


@query(
    rf"""
WITH RECURSIVE kinds(place, kind, pattern) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'),
  (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (9, 'candidate', '[^\x20\x09-\x0D]+')
), cut AS (
  SELECT doc_id, place, kind, regexp_extract_all(coalesce(text, ''), pattern, 0) AS ms, regexp_split_to_array(coalesce(text, ''), pattern) AS gaps
  FROM documents, kinds
), pieces AS (
  SELECT doc_id, place, kind, m, gap, i, concat_ws(' ', lag(m, 3) OVER w, lag(gap, 2) OVER w, lag(m, 2) OVER w, lag(gap) OVER w, lag(m) OVER w, gap) AS before,
    concat_ws(' ', next_gap, lead(m) OVER w) AS after
  FROM (SELECT doc_id, place, kind, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(gaps[2:len(ms) + 1]) AS next_gap, unnest(range(1, len(ms) + 1)) AS i FROM cut)
  WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)
), every AS (
  SELECT doc_id, place, kind, m, before, after, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM pieces
), matches AS (
  SELECT *, e - length(m) AS s FROM every
  WHERE kind <> 'candidate' OR (regexp_matches(m, '(?s)^["''(<\[]*[A-Za-z0-9+#@].{{4,}}$') AND regexp_matches(m, '[0-9@]'))
), trimmed AS (
  SELECT p.doc_id, place, kind, before, after,
    CASE kind WHEN 'candidate' THEN s + length(regexp_extract(m, '^["''(<\[]*')) ELSE s END AS s,
    CASE kind WHEN 'candidate' THEN e - length(regexp_extract(m, '["'')>\].,;:!?]+$')) ELSE e END AS e,
    CASE kind WHEN 'candidate' THEN regexp_replace(regexp_replace(m, '["'')>\].,;:!?]+$', ''), '^["''(<\[]*', '') ELSE m END AS found,
    regexp_replace(m, '[^0-9]', '', 'g') AS digits
  FROM matches p
), held AS (
  SELECT * FROM trimmed WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and([length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) <= 255 FOR x IN string_split(found, '.')])
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum([
      CASE WHEN (length(digits) - j) % 2 = 0 THEN digits[j]::INT WHEN digits[j]::INT > 4 THEN 2 * digits[j]::INT - 9 ELSE 2 * digits[j]::INT END
      FOR j IN range(1, length(digits) + 1)]) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    ELSE length(found) >= 5 END
), base AS (
  SELECT * FROM held WHERE kind <> 'candidate'
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT h.* FROM held h WHERE kind = 'candidate' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.e AND h.s < b.e)
), contexts AS (
  SELECT found AS instance, {_WORDS_OF.format("before")} AS w,
    {_WORDS_OF.format("after")} AS v
  FROM spans
), edges AS (
  SELECT DISTINCT instance, pattern FROM (SELECT instance, unnest([
    CASE WHEN len(w) >= 2 THEN '2 ' || w[-2] || ' ' || w[-1] END,
    CASE WHEN len(w) >= 3 THEN '3 ' || w[-3] || ' ' || w[-2] || ' ' || w[-1] END,
    CASE WHEN len(w) >= 1 AND len(v) >= 1 THEN 'b ' || w[-1] || ' _ ' || v[1] END]) AS pattern FROM contexts)
  WHERE pattern IS NOT NULL
), seeds AS (
  SELECT DISTINCT found AS instance, kind FROM base
), able AS (
  SELECT pattern, kind FROM edges JOIN seeds USING (instance) GROUP BY pattern, kind HAVING count(*) >= 3
), inside AS (
  SELECT * FROM edges WHERE pattern IN (SELECT pattern FROM able)
), sizes AS (
  SELECT pattern, count(*) AS n FROM inside GROUP BY pattern
), rounds AS (
  SELECT -1 AS number, instance, kind, 1.0::DOUBLE AS score, -1.0::DOUBLE AS total, -2.0::DOUBLE AS total_before FROM seeds
  UNION ALL
  SELECT number + 1, instance, kind, score, sum(score) OVER () AS total, total AS total_before FROM (
    SELECT number, instance, kind, 1 - exp(sum(ln(greatest(1 - confidence, 1e-6)))) AS score, any_value(total) AS total
    FROM inside JOIN (
      SELECT number, pattern, kind, sum(score) / any_value(n) AS confidence, any_value(total) AS total
      FROM able JOIN sizes USING (pattern) JOIN inside USING (pattern) JOIN (
        SELECT DISTINCT r.number, r.total, held.instance, held.kind, held.score
        FROM (SELECT DISTINCT number, total FROM rounds WHERE abs(total - total_before) > 1e-6) r,
          (SELECT instance, kind, 1.0::DOUBLE AS score FROM seeds UNION ALL SELECT instance, kind, score FROM rounds WHERE number >= 0) held
      ) AS held USING (instance, kind)
      GROUP BY number, pattern, kind HAVING sum(score) / any_value(n) >= 0.8
    ) AS trust USING (pattern) WHERE instance NOT IN (SELECT instance FROM seeds) GROUP BY number, instance, kind)
), best AS (
  SELECT instance, arg_min(kind, struct_pack(d := -score, p := place)) AS kind
  FROM (SELECT * FROM rounds WHERE number >= 0 QUALIFY number = max(number) OVER ()) JOIN (SELECT place, kind FROM kinds) USING (kind) WHERE score >= 0.9 GROUP BY instance
), result AS (
  SELECT doc_id, place, kind, s, e, true AS own FROM base UNION ALL
  SELECT doc_id, 4 + k.place, 'context_' || b.kind, s, e, false FROM spans x
  JOIN best b ON b.instance = x.found JOIN kinds k ON k.kind = b.kind WHERE x.kind = 'candidate'
), per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (own), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans
  FROM result GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per_doc USING (doc_id)
"""
)
def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii_bootstrap.find_personal_data(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    spans = F.col("spans")
    return made.select(
        "doc_id",
        *(n_of(spans, k).alias(f"n_{k}") for k in BASE_PERSONAL),
        F.sha2(joined_spans(of_kinds(spans, BASE_PERSONAL)), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )


@query(
    r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, places.n AS n, i FROM places JOIN windows USING (words)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
)
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    made = decontaminate.decontaminate(docs, "doc_id", "text", items, "item_id", "text")
    return made.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with one of six things done to them, chosen by CRC-32 of ``conv_id:turn``."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1))).alias("copy")
    return rows.filter("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), twice).drop("copy")


def _best_sql(*candidates: str) -> str:
    return f"list_min([{', '.join(candidates)}])"


def _moved_sql(before: int, more: str, edits: str, when: str = "NOT gone") -> str:
    return f"CASE WHEN {when} THEN {{'c': s{before}.c + {more}, 'e': s{before}.e || '{edits}'}} ELSE far END"


_SURVIVORS_SQL = [
    _best_sql(_moved_sql(0, "3", "D", "true")),
    _best_sql(_moved_sql(1, "3", "D", "true"), _moved_sql(0, "cut", "K", "NOT gone AND initial = 's'")),
    _best_sql(
        _moved_sql(2, "3", "D", "true"),
        *(_moved_sql(x, "cut", "K", "NOT gone AND initial = 'u'") for x in (0, 1, 3)), _moved_sql(2, "cut + 2", "IK", "NOT gone AND initial = 'u'"),
        *(_moved_sql(x, "cut + 2", "R") for x in (0, 1, 3)), _moved_sql(2, "cut + 4", "IR"),
    ),
    _best_sql(
        _moved_sql(3, "3", "D", "true"),
        *(_moved_sql(x, "cut + 2", "IK", "NOT gone AND initial = 'a'") for x in (0, 1, 3)), _moved_sql(2, "cut", "K", "NOT gone AND initial = 'a'"),
        *(_moved_sql(x, "cut + 4", "IR") for x in (0, 1, 3)), _moved_sql(2, "cut + 2", "R"),
    ),
]


@query(
    rf"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t
), chosen AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: xor(t[((xor(c, b) & 255) + 1)::BIGINT], c >> 8))) % 20 AS what
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM chosen WHERE what <> 0
), numbered AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS initial_before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), faults AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered
), survivors AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': ''}} AS s0, {{'c': 1000000000::BIGINT, 'e': ''}} AS s1, {{'c': 1000000000::BIGINT, 'e': ''}} AS s2, {{'c': 1000000000::BIGINT, 'e': ''}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {", ".join(_SURVIVORS_SQL)} FROM (
    SELECT s.conv_id, f.i, s0, s1, s2, s3, f.initial, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut, {{'c': 1000000000::BIGINT, 'e': ''}} AS far
    FROM survivors s JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = s.i + 1)
), ended AS (
  SELECT conv_id, arg_max(list_min([s0, s3, {{'c': s2.c + 2, 'e': s2.e || 'I'}}, {{'c': s1.c + 4, 'e': s1.e || 'II'}}]), i) AS best FROM survivors GROUP BY conv_id
), letters AS (
  SELECT conv_id, k, best.e[k] AS letter, length(replace(best.e, 'D', '')) AS n_out,
    length(replace(best.e[:k], 'D', '')) AS place, length(replace(best.e[:k], 'I', '')) AS i
  FROM (SELECT conv_id, best, unnest(range(1, length(best.e) + 1)) AS k FROM ended)
), repaired AS (
  SELECT l.conv_id, string_agg(CASE letter WHEN 'K' THEN f.role ELSE CASE WHEN (place + n_out) % 2 = 1 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE letter WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS whole
  FROM letters l LEFT JOIN faults f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i WHERE letter <> 'D' GROUP BY l.conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (initial_before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.e AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON e.conv_id IS NOT DISTINCT FROM r.conv_id
"""
)
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = structure_repair.faulty(damaged(turns), "conv_id", "turn", "role", "text")
    made = structure_repair.report(structure_repair.in_order(rows))
    every = turns.select("conv_id").distinct()
    joined = every.join(made, every["conv_id"].eqNullSafe(made["conv"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query(
    r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counts AS (
  SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 6) AS t(k) WHERE len(w) >= k) GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM counts WHERE words > 1 AND a >= 100
), inside AS (
  SELECT lang, words AS longer, a, unnest(range(2, words)) AS size, string_split(phrase, ' ') AS w FROM candidates WHERE words > 2
), held AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS largest
  FROM (SELECT lang, a, size, w, unnest(range(1, longer - size + 2)) AS i FROM inside) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, words, a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k
  FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = c.lang AND h.phrase = c.phrase AND 100 * h.largest >= 100 * c.a)
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, f.a AS l, g.a AS r, n, ((1000::HUGEINT * c.a * n) // (f.a::HUGEINT * g.a))::BIGINT AS score
  FROM cuts c JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts g ON g.lang = c.lang AND g.phrase = array_to_string(c.w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"), "text", "lang")


@query()
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    # A null id has no remainder and is learned from, like every id that is not held out.
    model = language_id.train(docs.filter(~F.coalesce(held_out, F.lit(False))), "text", "lang")
    made = language_id.predict(docs.select("doc_id", "text"), "text", model)
    return made.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
