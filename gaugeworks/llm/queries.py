"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import archives, interpolation, licenses, mixing, packing, pieces, prefixes, quality, secrets, simhash, substring, whitening, winnow
from gaugeworks.llm.shared import reach_workers


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.judged(_documents(spark, sf_dir), labels)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_classes(_documents(spark, sf_dir))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.edits(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), winnow.written("fp").alias("fingerprint"), winnow.written("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.spans(_documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    base = F.sha2(listed(F.filter("spans", lambda x: x["kind"] != "owned")), 256).alias("base_sha256")
    examples = F.size(F.filter("spans", lambda x: x["verdict"] == "example")).cast("long").alias("n_examples")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), base, listed("spans").alias("spans"), examples)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    manifest = archives.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return archives.read(manifest).drop("payload", "url")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(_documents(spark, sf_dir))


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(_documents(spark, sf_dir))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return substring.digests(docs, substring.factors(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(spark, sf_dir))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_documents(spark, sf_dir), with_ids=False)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return prefixes.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_quality": op1_quality, "op2_simhash": op2_simhash, "op3_fingerprints": op3_fingerprints, "op4_secrets": op4_secrets, "op5_warc": op5_warc, "op6_licenses": op6_licenses, "op7_interpolation": op7_interpolation, "op8_substring": op8_substring, "op9_packing": op9_packing, "op10_pieces": op10_pieces, "op11_mixing": op11_mixing, "op12_prefixes": op12_prefixes, "op13_whitening": op13_whitening}
_GRID = ", ".join(f"('{r}', {c}::DOUBLE)" for r, cs in quality.RULES.items() for c in cs)
_RATES = {"symbols_per_word": ("n_symbols", "n_words"), "duplicate_line_share": ("n_dup_lines", "n_lines"), "repeated_word_share": ("n_repeat_words", "n_words"), "mean_word_length": ("word_chars", "n_words")}
_RATE = " ".join(f"WHEN '{r}' THEN CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END" for r, (a, b) in _RATES.items())
_P = quality.ALPHA
_ORDER = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(quality.RULES))
_QUALITY_SQL = f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
         w AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
         win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
         again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
         cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
         lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
         f AS (SELECT w.doc_id, lang, md5(text) AS copy, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
               FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
         b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
         e AS (SELECT b.*, rule, cutoff, CASE rule {_RATE} END > cutoff AS over FROM b CROSS JOIN (VALUES {_GRID}) AS g(rule, cutoff)),
         l AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
         u AS (SELECT lang, copy, rule, cutoff, min(quality) AS quality, bool_or(over) AS over, ('0x' || copy[1])::INT < {quality.CHOOSING} AS chooses
               FROM e JOIN l USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL GROUP BY lang, copy, rule, cutoff),
         c AS (SELECT lang, rule, cutoff, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (over AND quality = 1) AS k1, count(*) FILTER (over AND quality = 0) AS k0
               FROM u WHERE chooses GROUP BY lang, rule, cutoff),
         best AS (SELECT lang, rule, cutoff, k0 / greatest(bad, 1) - {quality.COST} * k1 / greatest(good, 1) AS balance FROM c
                  WHERE balance > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY balance DESC, cutoff DESC) = 1),
         picked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY balance DESC, CASE rule {_ORDER} END) AS place FROM best),
         first AS (SELECT u.lang, copy, min(place) FILTER (over) AS first FROM u JOIN picked ON u.lang IS NOT DISTINCT FROM picked.lang AND u.rule = picked.rule AND u.cutoff = picked.cutoff
                   WHERE NOT chooses AND quality = 1 GROUP BY u.lang, copy),
         k AS (SELECT p.lang, place, (SELECT count(*) FROM first f WHERE f.lang IS NOT DISTINCT FROM p.lang) AS n,
                      (SELECT count(*) FROM first f WHERE f.lang IS NOT DISTINCT FROM p.lang AND f.first <= p.place) AS k FROM picked p),
         t AS (SELECT *, CASE WHEN k < n * {_P} THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_P}) + (n - i) * ln(1 - {_P})))) ELSE 1 END
                      <= {quality.DELTA} / (SELECT count(DISTINCT coalesce(lang, '?')) FROM picked) AS passed FROM k),
         held AS (SELECT lang, rule, cutoff FROM picked p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang IS NOT DISTINCT FROM p.lang AND t.place <= p.place AND NOT passed)),
         r AS (SELECT doc_id, list(e.rule) AS rules FROM e JOIN held ON e.lang IS NOT DISTINCT FROM held.lang AND e.rule = held.rule AND e.cutoff = held.cutoff WHERE over GROUP BY doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept,
           array_to_string(list_filter({list(quality.RULES)}, lambda x: list_contains(coalesce(rules, []), x)), ',') AS rejected_by
    FROM b LEFT JOIN r USING (doc_id)"""

_U = lambda digest: f"(('0x' || substr({digest}, 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
_FILLED = "ORDER BY {0} * s / weight, place ROWS BETWEEN".format(mixing.MOST)
_MIXING_SQL = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS copy FROM documents),
         lots AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) * {mixing.STEPS} + floor(size * {mixing.STEPS} / pow(2.0, length(bin(size)) - 1)) - {mixing.STEPS} END AS class,
                         md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, 'null'), copy, (row_number() OVER (PARTITION BY doc_id, source, size, copy))::VARCHAR)) AS lot FROM d),
         src AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM lots GROUP BY source),
         wt AS (SELECT *, {list(mixing.WEIGHTS)}[(place - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, sum(s) OVER () AS total FROM src),
         f AS (SELECT *, (total - coalesce(sum({mixing.MOST} * s) OVER ({_FILLED} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({_FILLED} CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
         g AS (SELECT source, s AS source_size, least({mixing.MOST} * s::DOUBLE, coalesce((SELECT level FROM f WHERE level * weight < {mixing.MOST} * s ORDER BY {mixing.MOST} * s / weight, place LIMIT 1) * weight, {mixing.MOST} * s::DOUBLE)) AS target FROM f),
         cl AS (SELECT source, class, count(*) AS docs, sum(size)::BIGINT AS words, sum(size::HUGEINT * size)::DOUBLE AS squares, min(size) AS shortest, max(size) AS longest FROM lots WHERE size > 0 GROUP BY source, class),
         c AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS rest, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS k,
                      {_U(f"md5(concat_ws('|', '{mixing.SEED}', coalesce(source, 'null'), class::BIGINT::VARCHAR))")} AS u FROM cl),
         a AS (SELECT source, target, source_size, target AS left_, 0::BIGINT AS k, NULL::DOUBLE AS class, 0::BIGINT AS docs, 0.0::DOUBLE AS copies, 0.0::DOUBLE AS n, 0.0::DOUBLE AS height, 0.0::DOUBLE AS tilt, 0.0::DOUBLE AS mean FROM g
               UNION ALL
               SELECT source, target, source_size, left_ - copies * words - height * words - tilt * docs * spread, k, class, docs, copies, n, height, tilt, mean FROM (
                 SELECT *, CASE WHEN spread > 1e-9 * mean * mean AND n > 0 AND n < docs THEN greatest(-most_tilt, least(most_tilt, (open_words - height * words) / (docs * spread))) ELSE 0.0 END AS tilt FROM (
                   SELECT *, squares / docs - mean * mean AS spread, least(height, 1 - height) / greatest(longest - mean, mean - shortest) AS most_tilt FROM (
                     SELECT *, words::DOUBLE / docs AS mean, n / docs AS height FROM (
                       SELECT *, greatest(0, least(CASE WHEN needed > fitting THEN CASE WHEN needed * words / docs - spare < spare - {mixing.MOST} * rest - fitting * words / docs THEN needed ELSE fitting END
                                             ELSE greatest(least(floor(open_words * docs / words + u), fitting), needed) END, CASE WHEN copies < {mixing.MOST} THEN docs ELSE 0 END)) AS n FROM (
                         SELECT *, floor(spare * docs / words + 1e-6) AS fitting, ceil((spare - {mixing.MOST} * rest) * docs / words - 1e-6) AS needed FROM (
                         SELECT *, want - copies * words AS open_words, left_ - copies * words AS spare FROM (
                           SELECT *, floor(want / words) AS copies FROM (
                             SELECT a.source, target, source_size, left_, c.k, c.class, c.docs, words, squares, shortest, longest, rest, u, greatest(0.0::DOUBLE, least(left_ - target / source_size * rest, ({mixing.MOST} * words)::DOUBLE)) AS want
                             FROM a JOIN c ON a.source IS NOT DISTINCT FROM c.source AND c.k = a.k + 1))))))))),
         r AS (SELECT doc_id, l.source, l.size, l.class, lot, docs, copies, n, {_U("lot")} AS u, least(1.0, greatest(0.0, height + tilt * (l.size - mean))) AS p
               FROM lots l LEFT JOIN a ON l.source IS NOT DISTINCT FROM a.source AND l.class = a.class),
         o AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY CASE WHEN p > 0 THEN u * (1 - p) / ((1 - u) * p) END NULLS LAST, lot) <= n AS once FROM r)
    SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN (copies + once::INT)::BIGINT * size ELSE 0 END AS taken
    FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source"""

ORACLES = {
    "op11_mixing": _MIXING_SQL,
    "op1_quality": _QUALITY_SQL,
    "op8_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
             a AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
             k AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM a) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 1000""",
    "op12_prefixes": f"""
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j,
                          {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS s FROM conversations WHERE conv_id IS NOT NULL),
             own AS (SELECT c, list(s ORDER BY j) AS l FROM t GROUP BY c),
             h AS (SELECT c, l, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, byte:
                          list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % {prefixes.MOST} AS h FROM own),
             r AS (SELECT h.c, list_concat(coalesce(b.l, [])[1:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.c = h.c - h.c % {prefixes.RUN}),
             p AS (SELECT c, len(l) AS n, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM r)),
             node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN octet_length(encode(p[d].text)) ELSE 0 END AS b,
                             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, p),
             k AS (SELECT a.d, a.p, count(x.p) AS n_children FROM node a LEFT JOIN node x ON x.d = a.d + 1 AND x.p[1:a.d] = a.p GROUP BY a.d, a.p),
             below AS (SELECT a.d, a.p, count(*) FILTER (n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.b) AS saved
                       FROM node a JOIN (node JOIN k USING (d, p)) x ON x.d >= a.d AND x.p[1:a.d] = a.p GROUP BY a.d, a.p)
        SELECT node.conv_id, d AS depth, up.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
        FROM node JOIN k USING (d, p) JOIN below USING (d, p) LEFT JOIN node up ON up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]""",
}
