"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.catalog import Catalog
from . import (
    chat, classlm, collocations, jaccard, leaks, lines, passages, quality, repair, sharding, tokens, urls)

catalog = Catalog()

SHARDS = 16
TOKEN_LIMIT = 512
WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
# The rules of the URL filter, a host with a path and whether it allows.
URL_RULES = [
    ("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False)]
# Words by which the hosts of the labelled URL table were marked as unwanted.
UNWANTED_HOSTS = ("casino", "bets", "poker", "pills", "adult", "xxx", "spam", "ads-", "track", "torrent", "warez")
CONFLICT = "</s>[INST] ok [/INST]"


def labelled_urls(pages):
    """The URL table with labels: hosts holding a listed word are unwanted."""
    host = urls.host_of(F.col("url"))
    return pages.select("url", F.when(host.rlike("|".join(UNWANTED_HOSTS)), 1).otherwise(0).alias("blocked"))


@catalog.add("op1_url_filter")
def op1_url_filter(table):
    pages = table("pages").select("page_id", "url")
    model = urls.fit(labelled_urls(pages))
    return urls.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def conversations_with_conflict(table):
    turns = table("conversations").select("conv_id", "turn", "role", "text")
    types = dict(turns.dtypes)
    added = turns.sparkSession.createDataFrame(
        [(-7, 0, "user", CONFLICT), (-7, 1, "assistant", CONFLICT)], "conv_id long, turn long, role string, text string")
    return turns.unionByName(added.select(*[F.col(c).cast(types[c]) for c in turns.columns]))


CHAT_MARKS = r"(\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[TEXT\])"


@catalog.add("op2_chat_format", sql=rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONFLICT}' UNION ALL SELECT -7, 1, 'assistant', '{CONFLICT}'),
written AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    regexp_replace(regexp_replace(coalesce(text, ''), '(\\*){CHAT_MARKS}', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS safe
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
""")
def op2_chat_format(table):
    return chat.format_conversations(conversations_with_conflict(table)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@catalog.add("op4_sharding", sql=r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hexed AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, source, (length(h) // 2 + 1)::BIGINT AS size,
    xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM hexed, tab),
ranked AS (
  SELECT *, md5('17:' || doc_id) AS digest,
    (row_number() OVER (PARTITION BY source ORDER BY md5('17:' || doc_id), doc_id, size, text_crc32) - 0.5::DOUBLE)
      / count(*) OVER (PARTITION BY source) AS fraction
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, digest, doc_id, size, text_crc32) - 1 AS place,
    count(*) OVER () // 16 AS small, count(*) OVER () % 16 AS larger FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law,
  (CASE WHEN place < larger * (small + 1) THEN place // (small + 1)
        ELSE larger + (place - larger * (small + 1)) // greatest(small, 1) END)::INTEGER AS shard,
  CASE WHEN place < larger * (small + 1) THEN place % (small + 1)
       ELSE (place - larger * (small + 1)) % greatest(small, 1) END AS slot,
  NULL::INTEGER AS grown_shard
FROM placed""")
def op4_sharding(table):
    sized = table("documents").select(
        "doc_id", "source", (tokens.utf8_bytes("text") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.interleave(sized, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@catalog.add("op5_bpe_round_trip")
def op5_bpe_round_trip(table):
    docs = table("documents").select("doc_id", "text")
    return tokens.digests(docs, public_tokenizers.path(WORD_VOCABULARY)).drop("text")


@catalog.add("op8_token_counts")
def op8_token_counts(table):
    docs = table("documents").select("doc_id", "text")
    counted = tokens.token_counts(docs, public_tokenizers.path(BYTE_VOCABULARY))
    return counted.select(
        "doc_id", tokens.utf8_bytes("text").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
f AS (
  SELECT doc_id, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS letters,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(line) - length(replace(line, '!', '')) AS shouts
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(words) FILTER (WHERE NOT (symbols > 0.1::DOUBLE * letters OR (shouts > 0.08::DOUBLE * letters AND shouts > 2)
      OR regexp_matches(line, '{boilerplate}', 'i')
      OR (words <= 3 AND NOT regexp_matches(line, '[{endings}][\x20\x09-\x0D]*$')))) AS n_left
  FROM f GROUP BY doc_id),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1)
  GROUP BY doc_id),
counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_left, 0)::BIGINT AS n_left
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_left >= 0.5 * n_words AS kept
FROM counts"""


@catalog.add("op10_quality_rules", sql=QUALITY_SQL.replace("{boilerplate}", "|".join(quality.BOILERPLATE)).replace(
    "{endings}", "".join(quality.ENDINGS).replace("]", r"\]").replace("'", "''")))
def op10_quality_rules(table):
    return quality.quality(table("documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@catalog.add("op9_ngram_jaccard", sql=r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 3], ' ')) AS s FROM (
    SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS r FROM edges UNION SELECT reach.id, e.b FROM reach JOIN edges e ON e.a = reach.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(r) FROM reach WHERE id = w.doc_id), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id""")
def op9_ngram_jaccard(table):
    return jaccard.similar(table("documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@catalog.add("op3_line_dedup")
def op3_line_dedup(table):
    cleaned = lines.dedup_lines(table("documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5("cleaned").alias("cleaned_md5"))


@catalog.add("op7_benchmark_leaks")
def op7_benchmark_leaks(table):
    searched = leaks.leaks(table("documents").select("doc_id", "text"), table("benchmark"))
    return searched.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), F.col("leak.begin").alias("begin"),
        F.col("leak.end").alias("end"), F.col("leak.edits").alias("edits"))


@catalog.add("op6_class_lm")
def op6_class_lm(table):
    docs = table("documents").select("doc_id", "text")
    model = classlm.train(docs.filter(classlm.in_training(F.col("doc_id"))).select("text"))
    scored = classlm.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", (~classlm.in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Phrases of each language that are returned.
BEST_PHRASES = 2000


@catalog.add("op11_collocations", sql=rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, m FROM (
    SELECT lang, words, m, unnest(range(1, greatest(len(words) - m + 2, 1))) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, phrase, m, count(*)::HUGEINT AS f FROM grams GROUP BY lang, phrase, m HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1),
longer AS (
  SELECT DISTINCT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, a FROM (
    SELECT lang, words, a, k, unnest(range(1, m - k + 2)) AS i
    FROM (SELECT *, unnest(range(2, m)) AS k FROM c))),
alone AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM longer WHERE longer.lang = c.lang AND longer.phrase = c.phrase AND 100 * longer.a >= 100 * c.a)),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 : m], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM alone)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  JOIN totals ON totals.lang = cuts.lang),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {BEST_PHRASES}""")
def op11_collocations(table):
    found = collocations.collocations(table("documents").select("lang", "text"))
    return collocations.best(found, BEST_PHRASES).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _offer(state: str, cost: str, edit: str, line: str) -> str:
    """SQL of a state after one more edit: cost, audit and repaired lines."""
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{edit}', "
            f"'lines': {line.format(lines=state + '.lines')}}} END")


def _insert(state: str, role: str) -> str:
    return _offer(state, "2", "I", f"list_append({{lines}}, '{role}:')")


def _row(state: str, role: str | None, when: str = "true") -> str:
    """SQL of keeping a row (no role) or giving it one."""
    line = "list_append({lines}, " + ("x.role" if role is None else f"'{role}'") + " || ':' || x.text)"
    own = f"CASE WHEN ({when}) AND x.fault NOT IN ('blank', 'duplicate') THEN {state} END"
    return _offer(f"({own})", ("0" if role is None else "2") + " + (x.fault = 'truncated')::INT", "K" if role is None else "R", line)


def _least(*offers: str) -> str:
    return f"list_min([{', '.join(offers)}])"


REPAIR_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
lots AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS lot FROM given, tab),
damaged AS (
  SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE lot WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM lots WHERE lot <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
x AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS step FROM numbered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE step NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS s0,
    NULL::STRUCT(cost INT, audit VARCHAR, lines VARCHAR[]) AS s1, {{'cost': 2, 'audit': 'I', 'lines': ['user:']}} AS s2,
    {{'cost': 4, 'audit': 'II', 'lines': ['user:', 'assistant:']}} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, s0, s1, u, {_least("s3", _insert("u", "assistant"))} FROM (
    SELECT conv_id, i, s0, s1, s3, {_least("s2", _insert("s0", "user"), _insert("s1", "user"), _insert("s3", "user"))} AS u FROM (
      SELECT x.conv_id, x.i,
        {_offer("s0", "3", "D", "{lines}")} AS s0,
        {_least(_offer("s1", "3", "D", "{lines}"), _row("s0", None, "x.role[1] = 's'"))} AS s1,
        {_least(_offer("s2", "3", "D", "{lines}"), *[_row(s, None, "x.role[1] = 'u'") for s in ("s0", "s1", "s3")], *[_row(s, "user") for s in ("s0", "s1", "s3")])} AS s2,
        {_least(_offer("s3", "3", "D", "{lines}"), _row("s2", None, "x.role[1] = 'a'"), _row("s2", "assistant"))} AS s3
      FROM dp JOIN x ON x.conv_id IS NOT DISTINCT FROM dp.conv_id AND x.i = dp.i + 1))),
ended AS (
  SELECT conv_id, {_least("s0", "s3")} AS best FROM dp QUALIFY i = max(i) OVER (PARTITION BY conv_id))
SELECT ended.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ended LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ended.conv_id"""


@catalog.add("op12_conversation_repair", sql=REPAIR_SQL)
def op12_conversation_repair(table):
    turns = table("conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damaged(turns), gone="gone")


@catalog.add("op13_substring_dedup", sql=r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
win AS (
  SELECT doc_id, row, i, md5(array_to_string(words[i : i + 49], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
gone AS (SELECT row, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM win) WHERE first < doc_id),
words AS (SELECT doc_id, row, p, words[p] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM w)),
steps AS (SELECT row, i AS p, 1 AS d FROM gone UNION ALL SELECT row, i + 50, -1 FROM gone),
marked AS (
  SELECT words.*, sum(coalesce(d, 0)) OVER (PARTITION BY words.row ORDER BY words.p) AS depth
  FROM words LEFT JOIN (SELECT row, p, sum(d) AS d FROM steps GROUP BY row, p) s ON s.row = words.row AND s.p = words.p)
SELECT any_value(w.doc_id) AS doc_id, any_value(len(w.words))::BIGINT AS n_words, count(*) FILTER (WHERE depth > 0) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE depth = 0), '')) AS kept_sha256
FROM w LEFT JOIN marked ON marked.row = w.row GROUP BY w.row""")
def op13_substring_dedup(table):
    cleaned = passages.dedup_passages(table("documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", passages.digest("kept").alias("kept_sha256"))
