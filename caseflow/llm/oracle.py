"""SQL for the operators that SQL can express, by query name."""

from caseflow.llm.license_scan import LEAST_SHARE, PHRASES, SLACK, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP2 = r"""
WITH message AS (
  SELECT CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, conv_id,
         coalesce(turn // 4096, 0) AS part, turn, coalesce(role, 'unknown') AS role,
         coalesce(text, '') AS text
  FROM conversations),
speaker AS (SELECT DISTINCT alone, conv_id, part, role AS speaker FROM message
            WHERE role <> 'system'),
seen AS (
  SELECT s.alone, s.conv_id, s.part, s.speaker, m.turn, m.role, m.text, m.role = s.speaker AS own,
         '<|im_start|>' || CASE WHEN m.role = s.speaker THEN 'assistant'
           WHEN m.role = 'system' THEN 'system'
           ELSE 'user name=' || replace(regexp_replace(m.role, '\s+', '_', 'g'), '<|', '< |') END
           || chr(10) AS header,
         replace(m.text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM speaker s JOIN message m ON s.alone IS NOT DISTINCT FROM m.alone
    AND s.conv_id IS NOT DISTINCT FROM m.conv_id AND s.part = m.part),
placed AS (
  SELECT *, sum(length(header) + length(body)) OVER (
           PARTITION BY alone, conv_id, part, speaker ORDER BY turn NULLS FIRST, role, text
           ROWS UNBOUNDED PRECEDING) AS stop FROM seen)
SELECT conv_id, part, speaker, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(count(*) FILTER (own) AS INTEGER) AS n_own,
       string_agg(header || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
       string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ','
                  ORDER BY turn NULLS FIRST, role, text) FILTER (own) AS mask
FROM placed GROUP BY alone, conv_id, part, speaker
"""

OP5 = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + 12) AS words
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM item
        WHERE len(w) > 0)),
doc AS (SELECT doc_id, row_number() OVER () AS row_id, {_WORDS} AS w FROM documents),
window_of AS (
  SELECT row_id, i, n, list_slice(w, i, i + n - 1) AS words
  FROM (SELECT row_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM doc, (SELECT DISTINCT n FROM wanted) WHERE len(w) >= n)),
hit AS (SELECT row_id, i, n, item_id FROM window_of JOIN wanted USING (n, words)),
place AS (SELECT row_id, count(DISTINCT p) AS n_hit
  FROM (SELECT row_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY row_id),
named AS (
  SELECT row_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN place USING (row_id) LEFT JOIN named USING (row_id)
"""

OP7 = r"""
WITH rule AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
    ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rule_host, rule_path, v)),
part AS (
  SELECT row_number() OVER () AS row_id, page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0
              THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
page AS (
  SELECT row_id, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part),
fit AS (
  SELECT row_id, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY row_id
                            ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM page JOIN rule ON (host = rule_host OR ends_with(host, '.' || rule_host))
                     AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM page LEFT JOIN (SELECT * FROM fit WHERE place = 1) USING (row_id)
"""

OP1 = """
WITH whole AS (
  SELECT row_number() OVER () AS row_id, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY q.vec_id
                            ORDER BY list_inner_product(q.v, r.v) DESC, r.vec_id) AS place
  FROM whole q JOIN whole r ON q.vec_id <> r.vec_id AND q.vec_id % 50 = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM scored WHERE place <= 5
"""



def _level(name: str, parents: str, above: str, weight: str) -> str:
    """CTEs that share the budgets of ``above`` among the nodes of one level."""
    path = f"{parents}, {name}" if parents else name
    group = f"PARTITION BY {parents}" if parents else ""
    source = (f"(SELECT {path}, sum(capacity) AS capacity FROM leaf GROUP BY {path}) "
              + (f"JOIN {above} USING ({parents})" if parents else f"CROSS JOIN {above}"))
    return f"""
{name}_node AS (SELECT {path}, capacity, above, {weight} AS weight FROM {source}),
{name}_order AS (
  SELECT *, coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS taken,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still
  FROM {name}_node WHERE weight > 0
  WINDOW w AS ({group} ORDER BY CAST(capacity AS DOUBLE) / weight, {name})),
{name}_full AS (SELECT *, (above - taken) * weight >= capacity * still AS is_full
                FROM {name}_order),
{name}_share AS (
  SELECT {path}, CASE WHEN is_full THEN capacity ELSE
           ((above - coalesce(sum(capacity) FILTER (is_full) OVER ({group}), 0)) * weight)
           // coalesce(sum(weight) FILTER (NOT is_full) OVER ({group}), 1) END AS above
  FROM {name}_full)"""


OP6 = f"""
WITH doc AS (
  SELECT doc_id, 'domain' || CAST(CAST(nullif(regexp_extract(source, '^src([0-9]+)$', 1), '')
           AS BIGINT) % 3 AS VARCHAR) AS domain, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
leaf AS (
  SELECT coalesce(domain, chr(0)) AS d, coalesce(lang, chr(0)) AS l, coalesce(source, chr(0)) AS s,
         CAST(sum(n_tokens) AS HUGEINT) AS supply, CAST(sum(n_tokens) AS HUGEINT) * 4 AS capacity
  FROM doc GROUP BY ALL),
whole AS (SELECT sum(supply) * 80 // 100 AS above FROM leaf),
{_level("d", "", "whole", "CASE d WHEN 'domain0' THEN 2 WHEN 'domain1' THEN 5 "
        "WHEN 'domain2' THEN 3 ELSE 1 END")},
{_level("l", "d", "d_share", "CASE l WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 "
        "WHEN 'es' THEN 1 ELSE 1 END")},
{_level("s", "d, l", "l_share", "1")},
plan AS (
  SELECT d, l, s, CASE WHEN supply > 0 THEN above // supply ELSE 0 END AS epochs,
         CASE WHEN supply > 0 THEN above % supply ELSE 0 END AS rest
  FROM leaf JOIN s_share USING (d, l, s)),
placed AS (
  SELECT doc.*, d, l, s, epochs, rest,
         CAST('0x' || substr(sha256('13:' || CAST(epochs AS VARCHAR) || ':'
              || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
  FROM doc JOIN plan ON coalesce(domain, chr(0)) = d AND coalesce(lang, chr(0)) = l
                    AND coalesce(source, chr(0)) = s),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY d, l, s ORDER BY place) AS total FROM placed)
SELECT doc_id, domain, lang, source, n_tokens,
       CAST(epochs + CASE WHEN rest > 0 AND total <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM run WHERE epochs + CASE WHEN rest > 0 AND total <= rest THEN 1 ELSE 0 END > 0
"""


def _template_rows() -> str:
    rows = (f"({n}, '{t.label}', {t.k}, {0 if t.whole else SLACK}, "
            f"{1.0 if t.whole else LEAST_SHARE}, '{' '.join(t.words())}')"
            for n, t in enumerate(TEMPLATES))
    return ", ".join(rows)


OP11 = f"""
WITH template AS (
  SELECT *, string_split(words, ' ') AS w
  FROM (VALUES {_template_rows()}) AS t(template, label, k, slack, least, words)),
tgram AS (
  SELECT template, k, p, list_slice(w, p, p + k - 1) AS gram
  FROM (SELECT template, k, w, unnest(generate_series(1, len(w) - k + 1)) AS p FROM template)),
doc AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS w FROM documents),
dgram AS (
  SELECT row_id, k, i, list_slice(w, i, i + k - 1) AS gram
  FROM (SELECT row_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM doc, (SELECT DISTINCT k FROM template) WHERE len(w) >= k)
  WHERE w[i] IN (SELECT gram[1] FROM tgram)),
hit AS (SELECT row_id, template, k, i, p, i - p AS diagonal FROM dgram JOIN tgram USING (k, gram)),
voted AS (SELECT row_id, template, diagonal FROM hit GROUP BY ALL),
placed AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (
           PARTITION BY row_id, template ORDER BY diagonal) > slack, true) AS fresh
  FROM voted JOIN template USING (template)),
span AS (SELECT row_id, template, diagonal, sum(CAST(fresh AS INTEGER)) OVER (
           PARTITION BY row_id, template ORDER BY diagonal) AS span FROM placed),
found AS (
  SELECT row_id, template, label, min(i) - 1 AS first_word,
         count(DISTINCT p) / (len(any_value(w)) - any_value(t.k) + 1) AS share
  FROM hit JOIN span USING (row_id, template, diagonal) JOIN template t USING (template)
  GROUP BY row_id, template, label, span HAVING share >= any_value(least)),
summed AS (
  SELECT row_id, count(*) FILTER (template < {len(PHRASES)}) AS n_base,
         min(first_word) FILTER (template < {len(PHRASES)}) AS first_word,
         max(first_word) FILTER (template < {len(PHRASES)}) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (template < {len(PHRASES)}) AS base,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM found GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score
FROM doc LEFT JOIN summed USING (row_id)
"""

OP12 = f"""
WITH item AS (
  SELECT row_number() OVER () AS q, item_id, terms
  FROM (SELECT DISTINCT item_id, list_sort(list_distinct({_WORDS})) AS terms FROM benchmark)),
doc AS (SELECT row_number() OVER () AS row_id, doc_id, {_WORDS} AS words FROM documents),
whole AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words)) AS l FROM doc),
asked AS (SELECT q, item_id, unnest(terms) AS term FROM item),
posting AS (
  SELECT row_id, term, count(*) AS tf
  FROM (SELECT row_id, unnest(words) AS term FROM doc)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), whole),
long_as AS (SELECT row_id, doc_id, CAST(50 + (50 * len(words) * n) // l AS BIGINT) AS m
            FROM doc, whole WHERE len(words) > 0),
scored AS (
  SELECT q, item_id, doc_id, row_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term) JOIN long_as USING (row_id)
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 50
"""

# Parts, entries and rounds of the codebooks, and how often a component counts.
_PARTS, _ENTRIES, _ROUNDS, _SCALE = 8, 16, 6, 4096


def _round(number: int) -> str:
    """CTEs of one round: members of each entry, and the entries that follow from them."""
    return f"""
near{number} AS ({_nearest(f"book{number}")}),
mean{number} AS (
  SELECT position, entry, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT)
                               ORDER BY place) AS fresh
  FROM (SELECT position, entry, place, sum(part[place]) AS total, count(*) AS n
        FROM near{number}, (SELECT unnest(generate_series(1, (SELECT min(len(part)) FROM part)))
                            AS place)
        GROUP BY ALL) GROUP BY ALL),
book{number + 1} AS (SELECT position, entry, coalesce(fresh, centre) AS centre
                     FROM book{number} LEFT JOIN mean{number} USING (position, entry))"""


def _nearest(book: str) -> str:
    return f"""
  SELECT row_id, position, part, entry, away FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, position ORDER BY away, entry) AS place
    FROM (SELECT row_id, position, part, entry, CAST(list_sum(list_transform(
                   list_zip(part, centre), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS BIGINT) AS away
          FROM part JOIN {book} USING (position)))
  WHERE place = 1"""


OP13 = f"""
WITH whole AS (
  SELECT row_number() OVER () AS row_id, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({_SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
part AS (
  SELECT row_id, position, list_slice(v, position * len(v) // {_PARTS} + 1,
                                      (position + 1) * len(v) // {_PARTS}) AS part
  FROM whole, (SELECT unnest(generate_series(0, {_PARTS - 1})) AS position)),
book0 AS (
  SELECT position, place - 1 AS entry, part AS centre
  FROM (SELECT row_id, row_number() OVER (ORDER BY vec_id, v) AS place FROM whole)
  JOIN part USING (row_id) WHERE place <= {_ENTRIES}),
{",".join(_round(n) for n in range(_ROUNDS))},
final AS ({_nearest(f"book{_ROUNDS}")}),
coded AS (
  SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code,
         CAST(sum(away) AS BIGINT) AS error FROM final GROUP BY row_id),
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY position, entry, place)) AS codebooks_sha256
  FROM (SELECT position, entry, unnest(centre) AS x,
               unnest(generate_series(1, len(centre))) AS place FROM book{_ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       codebooks_sha256
FROM whole JOIN coded USING (row_id), digest
"""

ORACLE: dict[str, str] = {
    "op11_license_scans": OP11,
    "op12_ranked_search": OP12,
    "op13_vector_codes": OP13,
    "op6_source_mixing": OP6,
    "op1_exact_top_k": OP1,
    "op2_chat_formatting": OP2,
    "op7_url_filters": OP7,
    "op5_benchmark_decontamination": OP5,
}
