"""One query per corpus operator, with SQL oracles where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import alignment, conversations, decontamination, language_model, languages, licenses, main_text, mixing, near_duplicates, outliers, quality, secrets, urls
from .common import fold, table

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


BASE_SECRETS = ("assign", "access", "hex")


def quality_model(spark, sf_dir, docs):
    """Fitted on labelled rows outside fold 1; the pipeline uses the same model."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))


def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality_model(spark, sf_dir, docs), keep=["doc_id"])
    return found.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_outliers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return outliers.judge(docs).select("doc_id", *outliers.COUNTS, "base_failed", "kept")


def op3_urls(spark, sf_dir):
    """Outcomes: ``labels.quality`` of the document with the page's id (a convention of these tables)."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _span_list(spans):
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def op4_near_duplicates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, shingle=3, percent=85)


def op5_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, keep=["doc_id"])

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE_SECRETS))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_SECRETS],
        F.sha2(_span_list(base), 256).alias("base_sha256"),
        _span_list(F.col("secrets")).alias("spans"),
    )


def op6_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    return licenses.scan(docs, keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.start").cast("long").alias("first_word"),
        F.array_max("phrases.start").cast("long").alias("last_word"),
        labels("phrases.label").alias("base_labels"),
        labels("phrases.label", "licenses.label").alias("labels"),
        F.when(F.size("licenses") > 0, 1.0).when(F.size("phrases") > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op7_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profile = languages.profiles(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = languages.predict(docs.select("doc_id", "text"), profile, ["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = decontamination.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_language_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, sums = language_model.score_corpus(docs.withColumn("train", fold(F.col("doc_id"), 7) != 2))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(sums["n"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op11_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = main_text.extract(pages, main_text.fit(pages), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op12_conversations(spark, sf_dir):
    original = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = conversations.damage(original)
    return conversations.digests(conversations.repair(damaged, conversations.reports(damaged, original)))


def op13_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def _level_sql(name: str, children: str) -> str:
    """CTEs that give each row of ``children`` (n, k, prior, ...) its posterior a, b."""
    return f"""
    {name}_m AS (
      SELECT sum(pow(k - n * prior, 2)) AS spread, sum(n * prior * (1 - prior)) AS binomial,
             sum(n * (n - 1) * prior * (1 - prior)) AS pairs FROM {children}),
    {name}_s AS (
      SELECT 1.0::DOUBLE / least(greatest(CASE WHEN pairs > 0 THEN (spread - binomial) / pairs ELSE 0 END,
             0.001::DOUBLE), 0.5::DOUBLE) - 1.0::DOUBLE AS strength FROM {name}_m),
    {name} AS (
      SELECT c.*, strength * prior + k AS a, strength * (1 - prior) + n - k AS b FROM {children} c, {name}_s)"""


OP3_SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
placed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(r, '^[^/?#]*', 0),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
hosts AS (
  SELECT host, count(quality)::DOUBLE AS n, coalesce(sum(quality), 0)::DOUBLE AS k
  FROM placed LEFT JOIN labels ON page_id = doc_id GROUP BY host),
bare AS (SELECT *, regexp_replace(host, '^.*@|:\d*$', '', 'g') AS h FROM hosts),
parts AS (
  SELECT host, n, k, string_split(h, '.') AS p,
         array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') IN ({", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)}) AS two
  FROM bare),
named AS (
  SELECT host, n, k,
         array_to_string(CASE WHEN two THEN list_slice(p, -2, -1) ELSE list_slice(p, -1, -1) END, '.') AS suffix,
         array_to_string(CASE WHEN two THEN list_slice(p, -3, -1) ELSE list_slice(p, -2, -1) END, '.') AS domain
  FROM parts),
suffix_in AS (
  SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM named)::DOUBLE AS prior
  FROM named GROUP BY suffix),
{_level_sql("suffix_out", "suffix_in")},
domain_in AS (
  SELECT d.*, a / (a + b) AS prior
  FROM (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY domain, suffix) d
  JOIN suffix_out s ON s.suffix = d.suffix),
{_level_sql("domain_out", "domain_in")},
host_in AS (
  SELECT h.host, h.n, h.k, a / (a + b) AS prior
  FROM named h JOIN domain_out d ON d.domain = h.domain AND d.suffix = h.suffix),
{_level_sql("host_out", "host_in")},
judged AS (
  SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM host_out),
ruled AS (
  SELECT p.*, upper, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM placed p JOIN judged USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('10:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 13) AS hash
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
dealt AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (
             ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (
             ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM dealt),
stand AS (SELECT min_by(level, cap / weight) AS stand FROM levels WHERE cap / weight > level),
targets AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE stand * weight END AS target
  FROM levels, stand),
rates AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets),
bits AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM sized),
placed AS (
  SELECT doc_id, source, size, (bits * 16 + CASE WHEN bits > 4 THEN size >> (bits - 4) ELSE size END)::INT AS stratum, hash
  FROM bits),
strata AS (
  SELECT source, stratum, count(*) AS n, sum(size)::BIGINT AS words,
         row_number() OVER (PARTITION BY source ORDER BY stratum DESC) AS k,
         (sum(sum(size)) OVER (PARTITION BY source) - sum(sum(size)) OVER (PARTITION BY source ORDER BY stratum DESC)
          + sum(size))::BIGINT AS words_left,
         ('0x' || substr(md5('10:' || coalesce(source, '-') || ':' || stratum), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM placed GROUP BY source, stratum),
steps AS (
  SELECT s.*, rate - floor(rate) AS fraction FROM strata s JOIN rates r ON r.source IS NOT DISTINCT FROM s.source),
fold AS (
  SELECT source, 0::BIGINT AS k, -1 AS stratum, 0::DOUBLE AS copies, fraction * words_left AS lacks FROM steps WHERE k = 1
  UNION ALL
  SELECT source, k, stratum, floor(share * n + u), lacks - floor(share * n + u) * (words::DOUBLE / n)
  FROM (SELECT s.source, s.k, s.stratum, s.n, s.words, s.u, f.lacks, CASE WHEN words_left > 0
               THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, f.lacks / words_left)) ELSE fraction END AS share
        FROM fold f JOIN steps s ON s.source IS NOT DISTINCT FROM f.source AND s.k = f.k + 1)),
lasts AS (
  SELECT p.source, p.stratum, list_sort(list(hash))[any_value(copies)::INT] AS last
  FROM placed p JOIN fold f ON f.source IS NOT DISTINCT FROM p.source AND f.stratum = p.stratum WHERE copies > 0
  GROUP BY p.source, p.stratum)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN hash <= last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed p JOIN rates r ON r.source IS NOT DISTINCT FROM p.source
LEFT JOIN lasts l ON l.source IS NOT DISTINCT FROM p.source AND l.stratum = p.stratum
"""


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = rf"coalesce(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP5_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (
  SELECT * FROM (VALUES
    (1, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    (2, 'access', 'AKIA[A-Z0-9]+'),
    (3, 'hex', '[0-9a-f]{24,}'),
    (4, 'private_key', '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'),
    (5, 'github', 'gh[opsur]_[A-Za-z0-9]{36,}'),
    (6, 'slack', 'xox[abprs]-[A-Za-z0-9-]{10,}'),
    (7, 'google', 'AIza[A-Za-z0-9_-]{35,}'),
    (8, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
    (9, 'url_password', '[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/@]{1,64}@')) AS t(ord, kind, re)),
found AS (
  SELECT doc_id, ord, kind, regexp_extract_all(text, re) AS m, string_split_regex(text, re) AS gaps FROM cut, kinds),
placed AS (
  SELECT doc_id, ord, kind, m[i] AS match,
         list_sum(list_transform(gaps[:i], lambda x: length(x)))::BIGINT
         + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM found, unnest(range(1, len(m) + 1)) AS u(i)),
valid AS (
  SELECT doc_id, ord, kind, s, s + length(match) AS e FROM placed
  WHERE CASE kind WHEN 'access' THEN length(match) >= 20
        WHEN 'assign' THEN length(regexp_extract(match, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
        ELSE true END),
lists AS (
  SELECT doc_id, count(*) FILTER (ord = 1) AS n_assign, count(*) FILTER (ord = 2) AS n_access,
         count(*) FILTER (ord = 3) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord <= 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM valid GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN lists USING (doc_id)
"""

OP6_SQL = f"""
WITH cut AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
joined AS (SELECT doc_id, len(w)::BIGINT AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS j FROM cut),
phrases AS (SELECT * FROM (VALUES {", ".join(f"('{p}', '{x}')" for p, x in licenses.PHRASES)}) AS t(phrase, label)),
pieces AS (
  SELECT doc_id, label, string_split(j, ' ' || phrase || ' ') AS p, len(string_split(phrase, ' ')) AS size
  FROM joined, phrases WHERE contains(j, ' ' || phrase || ' ')),
placed AS (
  SELECT doc_id, label,
         (list_sum(list_transform(p[:i], lambda x: len(regexp_extract_all(x, '[^ ]+')))) + (i - 1) * size)::BIGINT AS place
  FROM pieces, unnest(range(1, len(p))) AS u(i)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
  FROM placed GROUP BY doc_id),
templates AS (
  SELECT * FROM (VALUES {", ".join(f"('{x}', '{licenses.template_regex(t)}')" for x, t in licenses.TEMPLATES)}) AS t(label, re)),
whole AS (
  SELECT doc_id, list(DISTINCT label) AS labels FROM joined, templates WHERE regexp_matches(j, re) GROUP BY doc_id)
SELECT c.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(t.labels, [])))), ',') AS labels,
       CASE WHEN t.labels IS NOT NULL THEN 1.0 WHEN b.labels IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM joined c LEFT JOIN base b USING (doc_id) LEFT JOIN whole t USING (doc_id)
"""

OP8_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
items AS (
  SELECT item_id, w, least(10, len(w)) AS size
  FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM items, unnest(range(1, len(w) - size + 2)) AS u(i)),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM docs, (SELECT DISTINCT size FROM items) AS s, unnest(range(1, greatest(len(w) - size + 2, 1))) AS u(i)),
hits AS (SELECT doc_id, i, g.size, item_id FROM grams g JOIN windows v ON v.gram = g.gram AND v.size = g.size),
covered AS (
  SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n_hit FROM hits, unnest(range(0, size)) AS u(o) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(
           flatten(list_transform(string_split(key, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END,
           4294967295::BIGINT)) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged),
judged AS (
  SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS initial,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'sound' END AS fault
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
free AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) AS t(p, q, role)),
inserted AS (
  SELECT p AS q, p, '' AS letters, [] :: VARCHAR[] AS lines FROM free
  UNION ALL SELECT p, q, 'I', [role || ':'] FROM free
  UNION ALL SELECT a.p, b.q, 'II', [a.role || ':', b.role || ':'] FROM free a JOIN free b ON b.p = a.q),
kept AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS t(p, initial, q)),
edits AS (
  SELECT conv_id, i, p, p AS q, 'D' AS letter, 3 AS cost, [] :: VARCHAR[] AS lines FROM judged, free
  UNION ALL
  SELECT conv_id, i, p, q, 'K', CASE fault WHEN 'truncated' THEN 1 ELSE 0 END, [role || ':' || text]
  FROM judged JOIN kept USING (initial) WHERE fault IN ('truncated', 'sound')
  UNION ALL
  SELECT conv_id, i, p, q, 'R', CASE fault WHEN 'truncated' THEN 3 ELSE 2 END, [f.role || ':' || text]
  FROM judged, free f WHERE fault IN ('truncated', 'sound')),
ways AS (
  SELECT conv_id, i, n.q AS p, e.q AS q, 2 * length(letters) + cost AS cost, letters || letter AS letters,
         list_concat(n.lines, e.lines) AS lines
  FROM edits e JOIN inserted n USING (p)),
best AS (
  SELECT conv_id, max(i) + 1 AS i, q, {'cost': 2 * length(letters), 'audit': letters, 'lines': lines} AS w
  FROM judged, (SELECT q, min(letters) AS letters, arg_min(lines, letters) AS lines FROM inserted WHERE p IN (0, 3) GROUP BY q)
  GROUP BY conv_id, q, letters, lines
  UNION ALL
  SELECT s.conv_id, s.i, s.p,
         min({'cost': s.cost + b.w.cost, 'audit': s.letters || b.w.audit, 'lines': list_concat(s.lines, b.w.lines)})
  FROM best b JOIN ways s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i - 1 AND s.q = b.q
  GROUP BY s.conv_id, s.i, s.p)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.w.cost, 0)::BIGINT AS cost,
       coalesce(b.w.audit, '') AS audit, sha256(coalesce(array_to_string(b.w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1 AND b.q = 0
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_outliers": op2_outliers,
        "op3_urls": op3_urls,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_secrets": op5_secrets,
        "op6_licenses": op6_licenses,
        "op7_languages": op7_languages,
        "op8_decontamination": op8_decontamination,
        "op9_language_model": op9_language_model,
        "op10_mixing": op10_mixing,
        "op11_main_text": op11_main_text,
        "op12_conversations": op12_conversations,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_urls": OP3_SQL,
        "op5_secrets": OP5_SQL,
        "op6_licenses": OP6_SQL,
        "op8_decontamination": OP8_SQL,
        "op10_mixing": OP10_SQL,
        "op12_conversations": OP12_SQL,
    }
