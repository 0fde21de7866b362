"""The same results in DuckDB's SQL, for the operators that SQL can express."""

from __future__ import annotations

from collections.abc import Iterable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[ \t\n\x0B\f\r]+"

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, list_filter(string_split_regex(text, '{_BLANK}'), lambda x: x <> '') AS words FROM docs
), windows AS (
  SELECT rid, pos, array_to_string(words[pos:pos + 4], ' ') AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS pos FROM worded WHERE len(words) >= 5)
), twice AS (
  SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1
), repeated AS (
  SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest(range(pos, pos + 5)) AS place FROM twice) GROUP BY rid
), raw_lines AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs
), with_word AS (
  SELECT rid, line, array_to_string(list_filter(string_split_regex(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '{_BLANK}'), lambda x: x <> ''), ' ') AS normal
  FROM raw_lines
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM with_word WHERE normal <> '' GROUP BY rid
), lines AS (
  SELECT rid, host, md5(text) AS text_key, normal, sum(len(string_split(normal, ' '))) AS words
  FROM with_word JOIN docs USING (rid) WHERE normal <> '' GROUP BY ALL
), split AS (
  SELECT rid, host, normal, string_split(normal, ' ') AS ws, CASE WHEN len(string_split(normal, ' ')) >= 8 THEN 4 ELSE 3 END AS n FROM lines
), parts AS (
  SELECT rid, host, normal, k, rest[k * len(rest) // m + 1:(k + 1) * len(rest) // m] AS part FROM (
    SELECT *, unnest(range(m)) AS k FROM (
      SELECT rid, host, normal, ws[n + 1:len(ws) - n] AS rest, CASE WHEN len(ws) - 2 * n >= 9 THEN 3 WHEN len(ws) - 2 * n >= 3 THEN 1 ELSE 0 END AS m FROM split WHERE len(ws) >= 2 * n))
), cores AS (
  SELECT *, list_position(list_transform(part, lambda x: strlen(x)), list_max(list_transform(part, lambda x: strlen(x)))) AS longest FROM parts
), keys AS (
  SELECT rid, host, normal, 0 AS place, normal AS key FROM lines
  UNION ALL SELECT rid, host, normal, 1, '<' || array_to_string(ws[:n], ' ') FROM split WHERE len(ws) >= 2 * n
  UNION ALL SELECT rid, host, normal, 2, '>' || array_to_string(ws[len(ws) - n + 1:], ' ') FROM split WHERE len(ws) >= 2 * n
  UNION ALL SELECT rid, host, normal, 3 + k, k || '|' || array_to_string(part[greatest(1, longest - 1):longest + 1], ' ') FROM cores
), often AS (
  SELECT host, key FROM keys GROUP BY host, key HAVING count(*) > 10
), hits AS (
  SELECT * FROM keys JOIN often USING (host, key)
), whole AS (
  SELECT DISTINCT host, normal FROM hits WHERE place = 0
), ends AS (
  SELECT host, key, min(substr(md5(normal), 1, 16)) AS stands FROM hits JOIN whole USING (host, normal) WHERE place > 0 GROUP BY ALL
), taken AS (
  SELECT rid, normal, coalesce(max(coalesce(stands, key)) FILTER (WHERE place = 2), max(coalesce(stands, key)) FILTER (WHERE place = 1),
    max(coalesce(stands, key)) FILTER (WHERE place = 3), max(coalesce(stands, key)) FILTER (WHERE place = 4), max(coalesce(stands, key)) FILTER (WHERE place = 5), substr(md5(normal), 1, 16)) AS stands
  FROM hits LEFT JOIN ends USING (host, key) GROUP BY rid, normal
), told AS (
  SELECT rid, md5(string_agg(DISTINCT coalesce(stands, substr(md5(normal), 1, 16)), ' ' ORDER BY coalesce(stands, substr(md5(normal), 1, 16)))) AS document
  FROM lines LEFT JOIN taken USING (rid, normal) WHERE rid IN (SELECT rid FROM hits) GROUP BY rid
), frequent AS (
  SELECT host, normal FROM hits JOIN told USING (rid) WHERE place = 0 GROUP BY host, normal HAVING count(DISTINCT document) > 10
), gone AS (
  SELECT rid, sum(words) AS removed FROM lines JOIN frequent USING (host, normal) GROUP BY rid
), facts AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed_words
  FROM worded LEFT JOIN dup USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - removed_words) >= 30 * n_words AS kept,
  removed_words::BIGINT AS removed_words
FROM facts
"""

_TWO = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'com.br', 'co.jp', 'co.in', 'co.nz')"


def _posterior(groups: str, key: str) -> str:
    """A beta posterior for each group of one level; `groups` has pages, bad and prior."""
    return f"""
  SELECT {key}, (prior * weight + bad) / (pages + weight) AS mean,
    (prior * weight + bad) * (pages + weight - prior * weight - bad) / ((pages + weight) * (pages + weight) * (pages + weight + 1)) AS variance
  FROM {groups}, (
    SELECT CASE WHEN extra > 0 THEN least(greatest(whole / extra - 1, 2.0), 200.0) ELSE 200.0 END AS weight FROM (
      SELECT sum(pages * ((bad / pages - prior) * (bad / pages - prior) - prior * (1 - prior) / pages)) AS extra, sum(pages * prior * (1 - prior)) AS whole
      FROM {groups} WHERE pages > 0))"""


URLS = rf"""
WITH split AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), outcomes AS (
  SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), two AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS two, count(bad)::DOUBLE AS pages, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM split LEFT JOIN outcomes USING (page_id) GROUP BY host
), hosts AS (
  SELECT host, pages, bad, CASE WHEN two IN {_TWO} THEN two ELSE string_split(host, '.')[-1] END AS suffix,
    CASE WHEN two IN {_TWO} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain FROM two
), suffix_groups AS (
  SELECT suffix, sum(pages) AS pages, sum(bad) AS bad, any_value(rate) AS prior
  FROM hosts, (SELECT coalesce(sum(bad) / nullif(sum(pages), 0), 0) AS rate FROM hosts) GROUP BY suffix
), suffixes AS ({_posterior("suffix_groups", "suffix")}
), domain_groups AS (
  SELECT domain, sum(pages) AS pages, sum(bad) AS bad, any_value(mean) AS prior FROM hosts JOIN suffixes USING (suffix) GROUP BY domain
), domains AS ({_posterior("domain_groups", "domain")}
), host_groups AS (
  SELECT host, pages, bad, mean AS prior FROM hosts JOIN domains USING (domain)
), reputations AS ({_posterior("host_groups", "host")}
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
  WHEN rule IS NOT NULL OR mean - 1.645 * sqrt(variance) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN reputations USING (host)
"""


def _words(text: str) -> str:
    return rf"list_filter(string_split_regex(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


LEAKS = f"""
WITH items AS (
  SELECT item_id, {_words("text")} AS words FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id::VARCHAR AS item, least(len(words), 10) AS size, array_to_string(words[pos:pos + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos FROM items WHERE len(words) > 0)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS words FROM documents
), doc_windows AS (
  SELECT rid, pos, size, array_to_string(words[pos:pos + size - 1], ' ') AS win FROM (
    SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM docs, (SELECT DISTINCT size FROM item_windows) WHERE len(words) >= size)
), hits AS (
  SELECT rid, pos, size, item FROM doc_windows JOIN item_windows USING (size, win)
), hit_words AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS place FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


def licenses(phrases: Iterable[tuple[str, str]], templates: Iterable[tuple[str, str]], telling: dict[str, str], pairs: dict[str, str], wanted: dict[int, set[str]]) -> str:
    """Base places and diagonals of the given phrases and templates, three-word runs as text; spans verified by their telling words, one after the other."""
    words_of = " ".join(f"WHEN '{word}' THEN '{what}'" for word, what in telling.items())
    pairs_of = " ".join(f"WHEN '{words}' THEN '{what}'" for words, what in pairs.items())
    own = ", ".join(f"({n}, '{','.join(sorted(own))}', {any(x.startswith('version') for x in own)})" for n, own in wanted.items())
    named = [(n, label, text.split(), phrase) for n, (text, label, phrase) in enumerate([(t, k, True) for t, k in phrases] + [(t, k, False) for k, t in templates])]
    rows = ", ".join(
        f"({n}, {at}, '{' '.join(words[at : at + 3])}', '{label}', {len(words)}, {phrase})" for n, label, words, phrase in named for at in range(len(words) - 2)
    )
    return f"""
WITH RECURSIVE positions(template, place, gram, label, size, phrase) AS (VALUES {rows}
), wanted(template, own, versioned) AS (VALUES {own}
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_words("text")} AS words FROM documents
), grams AS (
  SELECT rid, pos - 1 AS pos, array_to_string(words[pos:pos + 2], ' ') AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS pos FROM docs WHERE len(words) >= 3)
), votes AS (
  SELECT DISTINCT rid, template, label, size, phrase, pos - place AS diagonal, place FROM grams JOIN positions USING (gram)
), places AS (
  SELECT rid, label, diagonal AS start FROM votes WHERE phrase GROUP BY rid, template, label, size, diagonal HAVING count(*) = size - 2
), base AS (
  SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY rid
), diagonals AS (
  SELECT rid, template, diagonal, CASE WHEN diagonal - lag(diagonal) OVER own > 4 THEN 1 ELSE 0 END AS fresh
  FROM (SELECT DISTINCT rid, template, diagonal FROM votes WHERE NOT phrase) WINDOW own AS (PARTITION BY rid, template ORDER BY diagonal)
), runs AS (
  SELECT rid, template, diagonal, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM diagonals
), spans AS (
  SELECT rid, template, label, size, count(DISTINCT place + k) / size AS cover, min(diagonal + place) AS first, max(diagonal + place + 3) AS "end"
  FROM votes JOIN runs USING (rid, template, diagonal), range(3) AS covered(k) WHERE NOT phrase GROUP BY rid, template, label, size, run
), word_places AS (
  SELECT rid, pos - 1 AS spot, words[pos] AS word, CASE WHEN pos > 1 THEN words[pos - 1] ELSE '' END AS before
  FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS pos FROM docs WHERE rid IN (SELECT rid FROM spans))
), tells AS (
  SELECT rid, spot, CASE WHEN word = 'library' AND before <> 'gnu' THEN NULL ELSE coalesce(CASE word {words_of} END, CASE before || ' ' || word {pairs_of} END,
    CASE WHEN before IN ('version', 'v') AND regexp_full_match(word, '[0-9]+') THEN 'version ' || word END) END AS what FROM word_places
), told AS (
  SELECT s.rid, s.template, s.label, s.size, s.cover, s.first, s."end", w.own,
    coalesce(string_agg(DISTINCT what, ',' ORDER BY what) FILTER (WHERE w.versioned OR what NOT LIKE 'version%'), '') AS here
  FROM spans s JOIN wanted w USING (template) LEFT JOIN tells t ON t.rid = s.rid AND t.spot >= s.first AND t.spot < s."end"
  WHERE s.cover >= 0.8 AND s."end" - s.first <= 1.25 * s.size + 4 GROUP BY ALL
), ordered AS (
  SELECT rid, label, first, "end", row_number() OVER (PARTITION BY rid ORDER BY cover DESC, "end" - first - cover * size, size DESC, first, template) AS k FROM told WHERE here = own
), walk AS (
  SELECT DISTINCT rid, 0::BIGINT AS k, []::STRUCT(label VARCHAR, first BIGINT, "end" BIGINT)[] AS kept FROM ordered
  UNION ALL
  SELECT w.rid, o.k, CASE WHEN len(list_filter(w.kept, lambda x: x.label <> o.label AND x."end" > o.first AND o."end" > x.first)) > 0 THEN w.kept
    ELSE list_append(w.kept, {{'label': o.label, 'first': o.first, 'end': o."end"}}) END
  FROM walk w JOIN ordered o ON o.rid = w.rid AND o.k = w.k + 1
), found AS (
  SELECT rid, unnest(list_transform(arg_max(kept, k), lambda x: x.label)) AS label FROM walk GROUP BY rid
), labelled AS (
  SELECT rid, label, true AS base FROM places UNION SELECT rid, label, false FROM found
), joined AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM labelled GROUP BY rid
), best AS (
  SELECT rid, max(cover) AS cover FROM spans GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base USING (rid) LEFT JOIN joined USING (rid) LEFT JOIN best USING (rid)
"""

DIVERGENCE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms
  FROM documents
), seen AS (
  SELECT rid, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM seen GROUP BY lang, term HAVING count(DISTINCT rid) >= 3
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM seen JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS size FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(size, 0)::HUGEINT AS size FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS size FROM counts GROUP BY ALL) USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (g.size + v) AS p,
    1 + 1000000000::HUGEINT * (total + 1) // (l.size + v) AS whole
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts USING (lang, source, term)
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::HUGEINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM langs)
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, sum((a.p - b.p) * (a.p - b.p) // b.p) FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - whole) * (p - whole) // whole FROM shares WHERE n > 0 AND p > whole
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def secrets(strong: dict[str, str], weak: dict[str, str], hint: str, needs: Iterable[str], reach: int, chars: int) -> str:
    """Strong spans, and weak candidates that an access key or an identifier and an endpoint confirm in their scope."""

    def plain(pattern: str) -> str:
        for sign in "*+?}":
            pattern = pattern.replace(f"{sign}+", sign)
        return pattern.replace("'", "''")

    def found(role: str, pattern: str) -> str:
        keep = {
            "assign": f"length(regexp_extract(m, '{plain(strong['assign'])}', 2)) >= {chars}",
            "mixed": " AND ".join(f"regexp_matches(m, '{need}')" for need in needs),
        }.get(role, "true")
        given = "docs" if role in strong else "hinted"
        return f"""SELECT rid, '{role}' AS role, first AS start, first + length(m) AS "end" FROM (
    SELECT rid, ms[i] AS m, (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS first
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{plain(pattern)}') AS ms, string_split_regex(text, '{plain(pattern)}') AS gs FROM {given}))
  ) WHERE {keep}"""

    every = "\n  UNION ALL ".join(found(role, pattern) for role, pattern in (strong | weak).items())
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), hinted AS (
  SELECT * FROM docs WHERE contains(text, 'AKIA') OR regexp_matches(text, '{plain(hint)}')
), found AS (
  {every}
), base AS (
  SELECT rid, role AS kind, start, "end", CASE role WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END AS place FROM found WHERE role IN ('assign', 'access', 'hex')
), scoped AS (
  SELECT f.*, (SELECT count(*) FROM found b WHERE b.rid = f.rid AND b.role = 'blank' AND b.start < f.start) AS scope FROM found f WHERE role NOT IN ('blank', 'assign', 'hex')
), candidates AS (
  SELECT DISTINCT rid, start, "end", scope FROM scoped c WHERE role IN ('weak', 'mixed') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c."end" AND b."end" > c.start)
), sure AS (
  SELECT c.rid, c.start, c."end" FROM candidates c JOIN scoped o ON c.rid = o.rid AND c.scope = o.scope AND o.role IN ('access', 'identifier', 'endpoint')
    AND o.start <= c."end" + {reach} AND o."end" >= c.start - {reach} AND (o."end" <= c.start OR o.start >= c."end")
  GROUP BY ALL HAVING bool_or(o.role = 'access') OR (bool_or(o.role = 'identifier') AND bool_or(o.role = 'endpoint'))
), linked AS (
  SELECT s.* FROM sure s WHERE NOT EXISTS (SELECT 1 FROM sure e WHERE e.rid = s.rid AND (e.start < s.start OR (e.start = s.start AND e."end" > s."end")) AND e."end" > s.start)
), spans AS (
  SELECT rid, kind, start, "end", place FROM base UNION ALL SELECT rid, 'linked', start, "end", 3 FROM linked
), listed AS (
  SELECT rid, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) AS spans,
    coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, place) FILTER (WHERE kind <> 'linked'), '') AS own,
    count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'linked') AS n_linked
  FROM spans GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0)::BIGINT AS n_linked
FROM docs LEFT JOIN listed USING (rid)
"""
