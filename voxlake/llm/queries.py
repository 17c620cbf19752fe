"""The operators over their whole tables, with production parameters, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from voxlake.llm import chat, decontaminate, line_dedup, mixing, quality, sharding, simhash, sql, token_binary, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    listed = F.concat_ws(",", F.sort_array(F.transform("contamination.item_ids", lambda x: x.cast("string"))))
    return judged.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bk AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM grams),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
hits AS (SELECT a.doc_id, a.i, a.k, g.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM spots) a JOIN grams g USING (k, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP2_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, array_to_string(w[i:i + 2], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
{sql.xxh64("shingle", "s")},
bits AS (SELECT r, count(*) AS n, {', '.join(f'sum(CAST((h >> {b}) & 1 AS BIGINT)) AS b{b}' for b in range(64))} FROM s JOIN hashed ON shingle = t GROUP BY r),
prints AS (SELECT doc_id, CAST(coalesce({' + '.join(f'CASE WHEN 2 * b{b} > n THEN {1 << b}::UHUGEINT ELSE 0 END' for b in range(64))}, 0) AS UBIGINT) AS fp FROM d LEFT JOIN bits USING (r)),
u AS (SELECT fp, min(doc_id) AS first FROM prints GROUP BY fp),
links AS (SELECT a.fp AS a, b.fp AS b FROM u a, u b WHERE bit_count(CAST(CAST(xor(a.fp, b.fp) AS HUGEINT) - CASE WHEN xor(a.fp, b.fp) >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT)) <= 3),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT reach.a AS fp, min(first) AS component_id FROM reach JOIN u ON u.fp = reach.b GROUP BY reach.a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES).drop("low")


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, seen
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, @seen@ AS seen FROM pages)),
rules(rule, name, prefix, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM cut, rules WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix) GROUP BY page_id),
ruled AS (
  SELECT c.page_id, host, path, b.rule, b.v, CASE WHEN regexp_matches(host, '(^|[^a-z])(@words@)([^a-z]|$)') THEN 1 WHEN seen IS NULL THEN NULL WHEN (length(seen) - length(translate(seen, '#*$%|<>', ''))) * 10 > length(seen) THEN 1 ELSE 0 END AS o
  FROM cut c LEFT JOIN best b USING (page_id)),
hosts AS (
  SELECT host, count(o) AS n, CAST(coalesce(sum(o), 0) AS BIGINT) AS bad,
    CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN regexp_extract(host, '((ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1) ELSE regexp_extract(host, '([^.]+)$', 1) END AS suffix,
    CASE WHEN regexp_matches(host, '^([^.]+\.)*[^.]+\.(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN regexp_extract(host, '([^.]+\.(ac|co|com|edu|gov|net|org)\.[a-z]{2})$', 1)
         WHEN regexp_matches(host, '[^.]+\.[^.]+$') THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host END AS domain
  FROM ruled GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
overall AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0)::DOUBLE AS prior FROM suffixes),
s1 AS (SELECT suffix, n, bad, prior FROM suffixes, overall),
@weight s1 w1@,
s2 AS (SELECT suffix, (bad + weight * prior) / (n + weight) AS prior FROM s1, w1),
d1 AS (SELECT domain, d.suffix, n, bad, prior FROM domains d JOIN s2 USING (suffix)),
@weight d1 w2@,
d2 AS (SELECT domain, suffix, n AS domain_n, (bad + weight * prior) / (n + weight) AS prior FROM d1, w2),
h1 AS (SELECT host, domain_n, hosts.n, bad, prior FROM hosts JOIN d2 USING (domain, suffix)),
@weight h1 w3@,
h2 AS (SELECT host, domain_n, n, weight, (bad + weight * prior) / (n + weight) AS rate FROM h1, w3),
low AS (SELECT host, domain_n, rate - 1.645 * sqrt(rate * (1 - rate) / (n + weight + 1)) AS low FROM h2)
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN low > 0.2 AND domain_n > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM ruled r LEFT JOIN low USING (host)
"""
_SEEN = "html"
for _pattern, _to in [(x, " ") for x in url_filter.HIDDEN] + [(r"[ \x09-\x0D]+", "")]:
    _SEEN = f"regexp_replace({_SEEN}, '{_pattern}', '{_to}', 'g')"
OP3_SQL = OP3_SQL.replace("@seen@", _SEEN).replace("@words@", "|".join(url_filter.BAD_WORDS))
for _from, _to in (("s1", "w1"), ("d1", "w2"), ("h1", "w3")):
    OP3_SQL = OP3_SQL.replace(
        f"@weight {_from} {_to}@",
        f"""{_to} AS (
  SELECT greatest(1.0, least(100.0, coalesce(CASE WHEN within > 0 AND sn > g THEN CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 100.0 END ELSE 1.0 END, 1.0))) AS weight
  FROM (SELECT *, (spread / (within / sn) - g) / (sn - g) AS rho FROM (
    SELECT sum(n)::DOUBLE AS sn, count(*) AS g, sum(n * (bad / n - prior) * (bad / n - prior)) AS spread, sum(n * prior * (1 - prior)) AS within FROM {_from} WHERE n > 0)))""",
    )

#: Text of the conversation that the query adds.
ADDED = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", ADDED), (-1, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    # every row is a message: rows of one turn are told apart by their place among them
    copy = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    back = chat.read_back(chat.format_chats(chat.as_log(rows.withColumn("copy", copy))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS t, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;') AS r FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

WEIGHTS, SHARE, MOST = [3.0, 1.0, 2.0], 1.5, 2.0


def op5_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), WEIGHTS, SHARE, MOST).select("doc_id", "size", "source_size", "target", "taken", "slot")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    md5(coalesce('=' || doc_id, '-') || chr(1) || coalesce('=' || source, '-') || chr(1) || coalesce('=' || text, '-')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0 * source_size AS cap, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight < cap),
t AS (SELECT source, source_size, CAST(CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS DOUBLE) AS target FROM l, f),
e AS (SELECT source, sum(words) OVER (ORDER BY encode(source) NULLS LAST) AS upto, sum(words) OVER () AS total FROM (SELECT source, CAST(floor(target) AS HUGEINT) AS words FROM t WHERE target >= 1)),
h AS (SELECT source, CAST(upto * 2147483648 // total AS BIGINT) AS high, CAST(total AS BIGINT) AS total FROM e),
i AS (SELECT source, high, coalesce(lag(high) OVER (ORDER BY encode(source) NULLS LAST), 0) AS low FROM h),
z AS (SELECT max(total) AS total, CAST(greatest(1, least(1024, (max(total) + 65535) // 65536)) AS BIGINT) AS words FROM h),
-- golden-ratio points of the slots, and the slots of each source by rank
g AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, (((slot + 1) & 2147483647) * 1327217885) & 2147483647 AS p FROM (SELECT unnest(range((total + words - 1) // words)) AS slot FROM z)) JOIN i ON p >= low AND p < high),
k AS (SELECT t.source, source_size, target, CAST(least(2 * source_size, coalesce(n, 0) * z.words) AS BIGINT) AS words, z.words AS slot_words
  FROM t CROSS JOIN z LEFT JOIN (SELECT source, count(*) AS n FROM g GROUP BY source) c ON t.source IS NOT DISTINCT FROM c.source),
p AS (SELECT d.*, source_size, target, words, slot_words,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size, mark ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(least(size, greatest(0, words - start)) + least(size, greatest(0, words - source_size - start)) AS BIGINT) AS taken, g.slot
FROM p LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source AND g.rank = start // slot_words AND size > 0 AND start < words
"""


def op6_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


OP7_SQL = f"""
WITH RECURSIVE k AS (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
jump(id, n, state, b, j) AS (
  SELECT id, n, CAST(id AS HUGEINT) + CASE WHEN id < 0 THEN 18446744073709551616 ELSE 0 END, -1::BIGINT, 0::BIGINT FROM k, (VALUES (8), (9)) v(n)
  UNION ALL
  SELECT id, n, state, j, CAST(floor((j + 1) * (2147483648::DOUBLE / CAST(state // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT id, n, j, (state * 2862933555777941757 + 1) % 18446744073709551616 AS state FROM jump WHERE j < n)),
placed AS (SELECT id, CAST(max(CASE WHEN n = 8 THEN b END) AS INT) AS shard, CAST(max(CASE WHEN n = 9 THEN b END) AS INT) AS grown_shard FROM jump WHERE j >= n GROUP BY id),
sized AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {sql.crc32("coalesce(text, '')")} AS text_crc32 FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM sized JOIN placed ON id = coalesce(doc_id, 0)
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.tokenized(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.judged(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS place FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)),
l AS (SELECT place, line, body, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT place, unnest(lines) AS body, unnest(range(len(lines))) AS line FROM (SELECT place, string_split(text, chr(10)) AS lines FROM d))),
-- lines equal to an earlier line, and the runs of such pairs side by side
p AS (SELECT a.place AS from_place, b.place, b.line - a.line AS off, b.line, b.words FROM l a JOIN l b ON a.body = b.body AND (a.place < b.place OR (a.place = b.place AND a.line < b.line))),
g AS (SELECT *, line - row_number() OVER (PARTITION BY from_place, place, off ORDER BY line) AS island FROM p),
runs AS (SELECT place, min(line) AS first, max(line) AS last FROM g GROUP BY from_place, place, off, island HAVING sum(words) >= @least@),
gone AS (SELECT DISTINCT place, unnest(range(first, last + 1)) AS line FROM runs),
listed AS (SELECT place, count(*) AS n, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM gone GROUP BY place)
SELECT o.doc_id, CAST(len(string_split(coalesce(o.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed
FROM documents o JOIN d ON d.doc_id IS NOT DISTINCT FROM o.doc_id AND d.text = coalesce(o.text, '') LEFT JOIN listed USING (place)
""".replace("@least@", str(line_dedup.LEAST_WORDS))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_reputation": op3_url_reputation,
    "op4_chat_format": op4_chat_format,
    "op5_mix_schedule": op5_mix_schedule,
    "op6_quality_mcd": op6_quality_mcd,
    "op7_jump_shards": op7_jump_shards,
    "op8_token_binary": op8_token_binary,
    "op9_toxicity_gru": op9_toxicity_gru,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op2_simhash_near_dedup": OP2_SQL,
    "op3_url_reputation": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op5_mix_schedule": OP5_SQL,
    "op7_jump_shards": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
}
