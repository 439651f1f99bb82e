"""DuckDB SQL for the named queries, written independently of the operators."""

from __future__ import annotations

from waymark.plans import bindings as B

_DOCS = f"docs AS ({B.AGENT_DOCS})"
_KNOW = f"know AS ({B.KNOWLEDGE})"
_OWN = f"own AS ({B.OWNERSHIP})"
_TERMS = f"terms AS ({B.TERMS})"
_NOTES = f"notes AS ({B.NOTES})"
_PAGES = f"page AS ({B.PAGES})"

_PARTS = rf"""{_DOCS}, parts AS (
  SELECT pos, path, raw, regexp_extract(path, '([^/]+)\.md$', 1) AS slug, regexp_matches(raw, '\A---\n(?s:.*?)\n---\n') AS has,
    regexp_extract(raw, '\A---\n((?s:.*?))\n---\n', 1) AS block, CASE WHEN regexp_matches(raw, '\A---\n(?s:.*?)\n---\n') THEN regexp_replace(raw, '\A---\n(?s:.*?)\n---\n', '') ELSE raw END AS body
  FROM docs
), field AS (
  SELECT *, nullif(regexp_extract(block, '(?m)^id: (.*)$', 1), '') AS f_id, nullif(regexp_extract(block, '(?m)^purpose: "(.*)"$', 1), '') AS f_purpose, nullif(regexp_extract(block, '(?m)^type: (.*)$', 1), '') AS f_type,
    nullif(regexp_extract(block, '(?m)^package: (.*)$', 1), '') AS f_package, nullif(regexp_extract(block, '(?m)^editRoot: (.*)$', 1), '') AS f_root, nullif(regexp_extract(block, '(?m)^humanDoc: (.*)$', 1), '') AS f_human,
    CASE WHEN regexp_matches(block, '(?m)^checks: ') THEN 'lint,test' END AS f_checks
  FROM parts
), line AS (
  SELECT pos, k, trim(t, ' ' || chr(9) || chr(13)) AS t FROM (SELECT pos, unnest(string_split(body, chr(10))) AS t, generate_subscripts(string_split(body, chr(10)), 1) AS k FROM parts)
), kind AS (
  SELECT pos, k, t, CASE WHEN t = '' THEN 'blank' WHEN t LIKE '#%' OR t LIKE '---%' THEN 'skip' WHEN t LIKE '```%' THEN 'fence' WHEN t LIKE '|%' OR t LIKE '- [%' OR t LIKE '* [%' THEN 'table' ELSE 'text' END AS kind FROM line
), first AS (
  SELECT pos, min(k) FILTER (kind = 'text') AS a, min(k) FILTER (kind = 'fence') AS f FROM kind GROUP BY pos
), stop AS (
  SELECT kind.pos, min(k) AS z FROM kind JOIN first ON kind.pos = first.pos AND k > a WHERE kind IN ('blank', 'fence', 'table') GROUP BY kind.pos
), run AS (
  SELECT pos, k, t, sum(length(t) + 1) OVER (PARTITION BY pos ORDER BY k) - length(t) - 2 AS before
  FROM kind JOIN first USING (pos) LEFT JOIN stop USING (pos) WHERE kind = 'text' AND (f IS NULL OR f > a) AND (z IS NULL OR k < z)
), para AS (
  SELECT pos, trim(regexp_replace(string_agg(t, ' ' ORDER BY k), '\s+', ' ', 'g')) AS t FROM run WHERE before < 400 GROUP BY pos
), cut AS (
  SELECT pos, t, left(t, 400) AS s,
    greatest(CASE WHEN strpos(reverse(left(t, 400)), ' .') > 0 THEN 399 - strpos(reverse(left(t, 400)), ' .') ELSE -1 END, CASE WHEN strpos(reverse(left(t, 400)), ' !') > 0 THEN 399 - strpos(reverse(left(t, 400)), ' !') ELSE -1 END, CASE WHEN strpos(reverse(left(t, 400)), ' ?') > 0 THEN 399 - strpos(reverse(left(t, 400)), ' ?') ELSE -1 END) AS sentence,
    CASE WHEN strpos(reverse(left(t, 400)), ' ') > 0 THEN 400 - strpos(reverse(left(t, 400)), ' ') ELSE -1 END AS word
  FROM para
), summary AS (
  SELECT pos, nullif(CASE WHEN length(t) <= 400 THEN t WHEN sentence > 160 THEN trim(left(s, sentence + 1)) WHEN word > 0 THEN trim(left(s, word)) ELSE s END, '') AS paragraph FROM cut
), built AS (
  SELECT coalesce(f_id, f_package, slug) AS id, coalesce(nullif(trim(regexp_extract(body, '(?m)^[ \t]*#[ \t]+([^\n]*\S[^\n]*)$', 1)), ''), f_id, f_package, slug) AS title, path, coalesce(f_purpose, paragraph) AS description,
    nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '```[\s\S]*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[[^\]]*\]\([^)]+\)', ' ', 'g'), '(?m)^#+\s+', '', 'g'), '[|>*_`#]', ' ', 'g'), '\s+', ' ', 'g')), 6000), '') AS body, pos
  FROM field LEFT JOIN summary USING (pos)
)"""

_SEEDS = rf"""{_PARTS}, seed AS (
  SELECT f_package AS id, f_root AS path, coalesce(f_purpose, description) AS purpose, f_checks AS checks, field.path AS "agentDoc", f_human AS "humanDoc", 'frontmatter' AS origin, field.pos
  FROM field JOIN built USING (pos) WHERE f_package IS NOT NULL AND f_root IS NOT NULL
  UNION ALL
  SELECT regexp_extract(field.path, '([^/]+)\.md$', 1), CASE WHEN field.path LIKE '%/pillars/%' THEN field.path ELSE concat('packages/', regexp_extract(field.path, '([^/]+)\.md$', 1)) END,
    coalesce(f_purpose, description, CASE WHEN field.path LIKE '%/pillars/%' THEN concat('Playbook pattern: ', regexp_extract(field.path, '([^/]+)\.md$', 1)) END), f_checks, field.path, f_human, 'path', field.pos
  FROM field JOIN built USING (pos) WHERE f_package IS NULL AND field.path NOT LIKE '%/notes/%'
)"""

# scores of one entry (hay, ident, path) for one term with its tokens
_HITS = """list_sum(list_transform(words, lambda t: CASE WHEN contains(hay, t) THEN length(t) * {weight} + CASE WHEN regexp_matches(hay, '(?:^|[^a-z0-9])' || t || '(?:[^a-z0-9]|$)') THEN length(t) ELSE 0 END ELSE 0 END))"""
_BOOST = """(CASE WHEN own_id = whole OR base = whole THEN 200 ELSE 0 END + CASE WHEN len(words) = 1 AND (own_id = words[1] OR base = words[1]) THEN 200 ELSE 0 END
 + list_sum(list_transform(words, lambda t: CASE WHEN own_id = t THEN 120 WHEN starts_with(own_id, t || '-') OR ends_with(own_id, '-' || t) THEN 40 WHEN contains(own_id, t) AND length(own_id) <= length(t) + 4 THEN 30 ELSE 0 END + CASE WHEN base = t THEN 100 ELSE 0 END))
 + CASE WHEN list_contains(words, own_id) THEN greatest(0, 40 - length(own_id)) ELSE 0 END)"""


def _search(asked: str, most: int) -> str:
    """CTEs that end in ranked (query_id, rank, type, id, path, summary, score); asked is a table (query_id, term)."""
    return rf"""asked AS (
  SELECT query_id, term, lower(trim(term)) AS whole, list_filter(string_split_regex(lower(term), '[^a-z0-9@/_-]+'), lambda t: length(t) >= 2) AS words,
    regexp_matches(term, '(?i)\b(package|module|pkg|edit|change|where|owns?|ownership|handoff|start)\b') OR regexp_matches(term, '(?i)\A(where|how).*(edit|change|package|module)') AS want
  FROM {asked}
), entry AS (
  SELECT 'knowledge' AS type, id, path, nullif(description, '') AS summary, pos, lower(concat(id, ' ', title, ' ', coalesce(description, ''), ' ', path, ' ', coalesce(body, ''))) AS hay, lower(id) AS own_id, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(?i)\.mdx?$', '')) AS base FROM know
  UNION ALL
  SELECT 'ownership', id, coalesce(agent_doc, path), nullif(purpose, ''), pos, lower(concat(id, ' ', path, ' ', coalesce(purpose, ''), ' ', coalesce("group", ''), ' ', coalesce(agent_doc, ''), ' ', coalesce(human_doc, ''))), lower(id), lower(regexp_replace(regexp_extract(coalesce(agent_doc, path), '([^/]*)$', 1), '(?i)\.mdx?$', '')) FROM own
), scored AS (
  SELECT query_id, words, want, type, id, path, summary, pos, CAST(CASE WHEN type = 'knowledge' THEN {_HITS.format(weight=1)} + {_BOOST} ELSE {_HITS.format(weight=2)} + {_BOOST} + CASE WHEN want THEN 40 ELSE 15 END END AS BIGINT) AS score
  FROM asked, entry WHERE len(words) > 0
), best AS (
  SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, path, type ORDER BY score DESC, pos) = 1
), place AS (
  SELECT query_id, path, min((CASE WHEN type = 'ownership' THEN 1 ELSE 0 END, pos)) AS spot FROM scored WHERE score > 0 GROUP BY ALL
), won AS (
  SELECT coalesce(o.query_id, k.query_id) AS query_id, coalesce(o.path, k.path) AS path, CASE WHEN k.query_id IS NULL OR o.score >= k.score - CASE WHEN o.want THEN 20 ELSE 0 END THEN o ELSE k END AS r
  FROM (SELECT * FROM best WHERE type = 'ownership') o FULL JOIN (SELECT * FROM best WHERE type = 'knowledge') k ON o.query_id = k.query_id AND o.path = k.path
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r.score DESC, list_contains(r.words, lower(r.id)) DESC, r.type = 'ownership' DESC, r.id, spot) AS rank, r.type AS type, r.id AS id, path, r.summary AS summary, r.score AS score
  FROM won JOIN place USING (query_id, path) QUALIFY rank <= {most}
)"""


_FOUND = f"{_KNOW}, {_OWN}, {_TERMS}, {_search('terms', 20)}"
_EDIT = "CASE WHEN human_doc IS NULL THEN concat('Human guide missing for ', id, '. Run: waymark bootstrap agent-docs') END"
_DISCOVERED = "SELECT concat('d', cast(p_partkey % 400 AS string)) AS id, concat('packages/part', cast(p_partkey AS string)) AS path, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name, p_partkey AS pos FROM part"
_LOCAL = "SELECT human_doc AS url FROM own WHERE human_doc IS NOT NULL AND NOT regexp_matches(human_doc, '^https?://')"
_CHUNKS = """SELECT r.query_id, r.rank, concat('waymark:', CASE WHEN r.type = 'ownership' THEN 'ownership' ELSE 'agent-doc' END, ':', r.id) AS "chunkKey", CASE WHEN r.type = 'ownership' THEN 'ownership' ELSE 'agent-doc' END AS type, r.id, r.path, nullif(k.title, '') AS title, coalesce(r.summary, o.purpose) AS summary, r.score
FROM ranked r LEFT JOIN (SELECT id, path, arg_min(title, pos) AS title FROM know GROUP BY ALL) k ON k.id = r.id AND k.path = r.path LEFT JOIN own o ON o.id = r.id WHERE r.rank <= 8"""
_STYLE = r"""SELECT path, raw, regexp_extract(raw, '\A---\n((?s:.*?))\n---', 1) AS head FROM docs"""
_has = lambda f: f"""regexp_matches(head, '(?m)^{f}:\\s*[''"]?[^''"\\n#]*[^''"\\n#\\s]')"""

_CLASSIFY = rf"""WITH {_NOTES}, r AS (SELECT id, fact, CASE WHEN regexp_matches(fact, '(?i)\b(noise|scratch|ignore|discard)\b') THEN 'discard' WHEN regexp_matches(fact, '(?i)\b(playbook|pattern|principle|best practice)\b') THEN 'playbook' WHEN regexp_matches(fact, '(?i)\b(user-facing|human guide|docs site|tutorial|guide)\b') THEN 'human' ELSE 'agent' END AS route FROM notes)
SELECT id, route, CASE route WHEN 'discard' THEN 'marked as noise' WHEN 'playbook' THEN 'generalizable pattern' WHEN 'human' THEN 'user-facing documentation' ELSE 'project convention or ownership note' END AS reason,
  nullif(regexp_extract(fact, '(?i)\b(?:package|module)\s+([a-z0-9._/-]+)\s+(?:owns|owner|responsible|routes?)\b', 1), '') AS target FROM r"""

SQL: dict[str, str] = {
    "knowledge_build": f"WITH {_PARTS} SELECT id, title, path, description, body, pos FROM built",
    "frontmatter_fields": rf"""WITH {_PARTS} SELECT pos, f_purpose AS purpose, f_checks AS checks, f_id AS plain_id, f_type AS doc_type, CAST(length(body) AS BIGINT) AS body_chars FROM field""",
    "search_rank": f"WITH {_FOUND} SELECT CAST(query_id AS BIGINT) AS query_id, rank, type, id, path, summary, score FROM ranked",
    "agent_search_envelope": f"""WITH {_FOUND}, c AS (
  SELECT *, CASE WHEN type = 'ownership' OR id IN (SELECT id FROM own) THEN concat('waymark query ownership ', id, ' --agent') ELSE 'waymark list knowledge --text' END AS command FROM ranked
), n AS (SELECT query_id, string_agg(command, '|' ORDER BY spot) AS next_commands FROM (SELECT query_id, command, min(rank) AS spot FROM c WHERE rank <= 5 GROUP BY ALL) GROUP BY query_id)
SELECT CAST(t.query_id AS BIGINT) AS query_id, t.term, coalesce(r.n, 0) AS n, r.best_id, least(coalesce(r.n, 0), 8) AS n_matches, coalesce(next_commands, '') AS next_commands
FROM terms t LEFT JOIN (SELECT query_id, count(*) AS n, max(id) FILTER (rank = 1) AS best_id FROM ranked GROUP BY ALL) r USING (query_id) LEFT JOIN n USING (query_id)""",
    "ask_route": f"""WITH {_FOUND} SELECT CAST(query_id AS BIGINT) AS query_id, r.type, r.id, r.score, CASE WHEN o.id IS NOT NULL THEN coalesce(agent_doc, '') END AS "startHere", o.path AS edit_roots
FROM (SELECT * FROM ranked WHERE rank <= 8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY type = 'ownership' DESC, rank) = 1) r LEFT JOIN own o ON o.id = r.id""",
    "question_packages": f"""WITH {_OWN}, {_TERMS} SELECT CAST(query_id AS BIGINT) AS query_id, arg_min(id, pos) AS id FROM terms, own WHERE list_contains(list_filter(string_split_regex(lower(term), '[^a-z0-9@/_-]+'), lambda t: length(t) >= 2), lower(id)) GROUP BY query_id""",
    "retriever_chunks": f"""WITH {_FOUND} SELECT CAST(query_id AS BIGINT) AS query_id, * EXCLUDE (query_id) FROM ({_CHUNKS})""",
    "ownership_seeds": f"WITH {_SEEDS} SELECT * FROM seed",
    "packages_merge": f"""WITH {_SEEDS}, e AS (SELECT concat('d', cast(s_suppkey AS string)) AS id, CASE WHEN s_suppkey % 4 <> 0 THEN concat('explicit/', cast(s_suppkey AS string)) END AS path FROM supplier),
d AS (SELECT id, arg_min(path, pos) AS path, arg_max(name, pos) FILTER (name IS NOT NULL) AS name, max(CASE WHEN pos % 2 = 0 THEN 'make test' END) AS checks FROM ({_DISCOVERED}) GROUP BY id),
s AS (SELECT id, arg_min(path, CASE WHEN origin = 'path' THEN 1000000000 ELSE 0 END + pos) AS path FROM seed GROUP BY id)
SELECT id, coalesce(e.path, d.path, s.path) AS path, d.name, d.checks FROM (SELECT id FROM e UNION SELECT id FROM d UNION SELECT id FROM s) LEFT JOIN e USING (id) LEFT JOIN d USING (id) LEFT JOIN s USING (id)""",
    "handoff_build": f"""WITH {_OWN} SELECT id, path, layer, coalesce(agent_doc, '') AS "startHere", concat_ws(',', agent_doc, 'AGENTS.md') AS read_first, human_doc AS "humanDoc",
CASE WHEN human_doc LIKE 'http%' THEN 'external' WHEN human_doc IS NOT NULL THEN 'linked' ELSE 'missing' END AS bridge, CASE WHEN human_doc IS NULL THEN concat('docs/for-agents/human/', id, '.md') END AS bootstrap, concat_ws('|', purpose, {_EDIT}) AS notes FROM own""",
    "agent_doc_guess": rf"""WITH {_PARTS}, p AS (SELECT DISTINCT id FROM ({_DISCOVERED})), hit AS (
  SELECT p.id, b.path, b.pos, CASE WHEN f.f_package = p.id THEN 1 WHEN b.id = p.id THEN 2 WHEN ends_with(b.path, '/packages/' || p.id || '.md') THEN 3 WHEN ends_with(b.path, '/' || p.id || '.md') THEN 7 WHEN contains(b.path, '/packages/' || p.id || '/') THEN 9 END AS rule
  FROM p, built b JOIN field f USING (pos) WHERE rule IS NOT NULL
) SELECT id, path AS guess FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY rule, pos) = 1""",
    "human_doc_match": rf"""WITH p AS (SELECT concat(CASE p_partkey % 5 WHEN 0 THEN 'os-' WHEN 1 THEN '@x/' ELSE '' END, 'h', cast(p_partkey AS string), CASE WHEN p_partkey % 7 = 0 THEN '-pattern' ELSE '' END) AS id FROM part),
h AS (SELECT concat(CASE page_id % 4 WHEN 0 THEN 'packages/' WHEN 1 THEN 'site/deep/' WHEN 2 THEN 'my-' ELSE '' END, 'h', cast(page_id AS string), CASE WHEN page_id % 6 = 1 THEN '/index' ELSE '' END) AS key, concat('/docs/', cast(page_id AS string)) AS url, page_id AS pos FROM pages WHERE page_id IS NOT NULL),
hit AS (SELECT p.id, h.url, h.pos, CASE WHEN key = id THEN 0 WHEN key = regexp_replace(id, '^@[^/]+/', '') THEN 1 WHEN key = regexp_replace(id, '^os-', '') THEN 2 WHEN key = regexp_replace(id, '-pattern$', '') THEN 3 WHEN key = 'packages/' || id THEN 4 WHEN key = 'reference/packages/' || id THEN 5 WHEN key = 'packages/' || id || '/index' THEN 6
  WHEN ends_with(key, '/' || id) OR ends_with(key, '/' || id || '/index') OR ends_with(key, '-' || id) THEN 7 END AS way FROM p, h WHERE way IS NOT NULL)
SELECT id, url FROM hit QUALIFY row_number() OVER (PARTITION BY id ORDER BY way, pos) = 1""",
    "human_doc_union": f"""WITH {_PAGES} SELECT id, url, path, source_pos FROM (SELECT *, CAST(pos % 2 AS BIGINT) AS source_pos FROM page WHERE path NOT LIKE 'docs/for-agents/%' AND path NOT LIKE '%/for-agents/%') QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_pos, pos) = 1""",
    "route_collision": f"WITH {_PAGES} SELECT id, url, path FROM page QUALIFY row_number() OVER (PARTITION BY url ORDER BY path LIKE '%/index.md' DESC, pos DESC) = 1",
    "human_links_missing": f"WITH {_OWN}, {_PAGES} SELECT DISTINCT url FROM ({_LOCAL}) WHERE url NOT IN (SELECT url FROM page WHERE pos % 3 <> 0)",
    "human_links_gate": f"""WITH {_OWN}, {_PAGES}, m AS (SELECT DISTINCT url FROM ({_LOCAL}) WHERE url NOT IN (SELECT url FROM page WHERE pos % 3 <> 0)), n AS (SELECT (SELECT count(*) FROM m) AS n, (SELECT string_agg(url, ', ' ORDER BY url) FROM (SELECT url FROM m ORDER BY url LIMIT 100)) || CASE WHEN (SELECT count(*) FROM m) > 100 THEN concat(', and ', (SELECT count(*) FROM m) - 100, ' more') ELSE '' END AS urls)
SELECT 'human-guide-links' AS id, n = 0 AS ok, CASE WHEN n = 0 THEN concat('Resolved ', (SELECT count(*) FROM ({_LOCAL})), ' humanDoc link(s)') ELSE concat('Missing humanDoc link(s): ', urls) END AS message, CASE WHEN n > 0 THEN 'all local humanDoc links resolve' END AS expected, CASE WHEN n > 0 THEN concat(n, ' missing') END AS actual FROM n""",
    "docs_style_gate": rf"""WITH {_DOCS}, s AS ({_STYLE}), m AS (SELECT path, concat_ws(',',
  CASE WHEN NOT regexp_matches(raw, '(?m)^#\s+\S+') THEN 'title' END, CASE WHEN NOT ({_has("purpose")} OR regexp_matches(raw, '(?im)^##\s+(Purpose|Goal)\b')) THEN 'purpose' END, CASE WHEN NOT ({_has("audience")} OR regexp_matches(raw, '(?im)^##\s+Audience\b')) THEN 'audience' END,
  CASE WHEN NOT regexp_matches(raw, '(?im)^##\s+(How to|Usage|Workflow|Tasks?)\b') THEN 'task-orientation' END, CASE WHEN NOT (regexp_matches(raw, '(?im)^##\s+Examples?\b') OR regexp_matches(raw, '```[\s\S]*?```')) THEN 'examples' END,
  CASE WHEN regexp_matches(raw, '(?i)\b(TODO|TBD|coming soon|eventually|placeholder)\b') THEN 'no-stale-wording' END, CASE WHEN NOT ({_has("owner")} OR {_has("source")} OR regexp_matches(raw, '(?im)^(Owner|Source):\s+\S+')) THEN 'owner-source' END) AS missing FROM s)
SELECT path, missing FROM m WHERE missing <> ''""",
    "okf_gate": rf"""WITH {_DOCS}, s AS ({_STYLE}), t AS (SELECT path, nullif(trim(regexp_extract(head, '(?m)^type:\s*[''"]?([^''"\n#]+)', 1)), '') AS type FROM s) SELECT path, type FROM t WHERE type IS NULL OR type NOT IN ('guide', 'package')""",
    "doctor_score": f"""WITH {_OWN}, {_PAGES}, {_DOCS}, {_KNOW}, c AS (SELECT count(*) AS total, count(*) FILTER (agent_doc IS NOT NULL AND agent_doc <> 'docs/d7.md') AS a, count(human_doc) AS h FROM own),
x AS (SELECT regexp_replace(path, '^.*/', 'docs/') AS path FROM docs), k AS (SELECT count(*) AS docs, count(*) FILTER (path IN (SELECT path FROM know WHERE pos % 3 = 0)) AS indexed FROM x WHERE path <> 'docs/d7.md'),
g AS (SELECT CASE WHEN (SELECT count(*) FROM ({_LOCAL}) WHERE url NOT IN (SELECT url FROM page)) = 0 THEN 2 ELSE 1 END AS gates_passed),
s AS (SELECT *, CAST(15 + floor(a / total * 35 + 0.5) + floor(h / total * 20 + 0.5) + CASE WHEN gates_passed = 2 THEN 15 ELSE 5 END AS BIGINT) AS score FROM c, k, g)
SELECT total, a AS with_agent_doc, h AS with_human_doc, docs, indexed, CAST(gates_passed AS BIGINT) AS gates_passed, CAST(2 AS BIGINT) AS gates, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
  CAST(floor(100 * a / total + 0.5) AS BIGINT) AS handoff_pct, CAST(floor(100 * h / total + 0.5) AS BIGINT) AS bridge_pct FROM s""",
    "doctor_issues": f"""WITH {_OWN}, {_PAGES}, m AS (SELECT DISTINCT url FROM ({_LOCAL}) WHERE url NOT IN (SELECT url FROM page WHERE pos % 3 <> 0)) SELECT CAST(1 AS BIGINT) AS kind, 'error' AS severity, 'index-stale' AS code, 'Index is stale. Run: waymark index' AS message, 'waymark index' AS action
UNION ALL SELECT 2, 'warn', 'missing-agent-doc', concat('Package "', id, '" has no dedicated agent doc.'), concat('waymark init --scaffold-workspaces  # or edit docs/for-agents/packages/', id, '.md') FROM own WHERE agent_doc IS NULL OR agent_doc = 'docs/d7.md'
UNION ALL SELECT 3, 'info', 'missing-human-doc', concat('Package "', id, '" has no linked human guide.'), 'waymark bootstrap agent-docs' FROM own WHERE human_doc IS NULL
UNION ALL SELECT 4, 'warn', 'gate-human-guide-links', concat('Missing humanDoc link(s): ', (SELECT string_agg(url, ', ' ORDER BY url) FROM (SELECT url FROM m ORDER BY url LIMIT 100)), CASE WHEN (SELECT count(*) FROM m) > 100 THEN concat(', and ', (SELECT count(*) FROM m) - 100, ' more') ELSE '' END), 'waymark gate run' WHERE (SELECT count(*) FROM m) > 0""",
    "conformance_summary": """SELECT CASE WHEN doc_id % 2 = 0 THEN 'required' ELSE 'recommended' END AS level, count(*) FILTER (quality = 1) AS passed, count(*) FILTER (quality IS DISTINCT FROM 1 AND doc_id % 3 <> 0) AS failed, count(*) FILTER (quality IS DISTINCT FROM 1 AND doc_id % 3 = 0) AS excepted,
bool_and(quality = 1 OR doc_id % 3 = 0) AS ok FROM labels GROUP BY 1""",
    "memory_classify": _CLASSIFY,
    "memory_draft_lines": f"""WITH c AS ({_CLASSIFY}), {_NOTES} SELECT pos, concat('- ', c.id, ': ', route, ' | reason=', reason, CASE WHEN target <> '' THEN concat(' | target=', target) ELSE '' END, ' | fact=', fact) AS line FROM c JOIN notes USING (id)""",
    "memory_safety": rf"""WITH {_NOTES}, f AS (SELECT id, fact FROM notes UNION ALL SELECT cast(doc_id AS string), text FROM documents)
SELECT id AS "candidateId", 'secret' AS kind, 'Potential secret-like value in memory fact' AS message FROM f WHERE regexp_matches(fact, '(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+')
UNION ALL SELECT id, 'private-email', 'Potential private email in memory fact' FROM f WHERE regexp_matches(regexp_replace(fact, '(?i)@example\.com\b', '@ ', 'g'), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b')""",
    "memory_duplicates": f"""WITH {_KNOW}, {_OWN}, {_NOTES}, chosen AS (SELECT id AS query_id, fact AS term FROM notes WHERE CAST(split_part(id, '-', 1) AS BIGINT) % 50 = 0), {_search("chosen", 1)} SELECT query_id AS id, path AS "duplicateOf" FROM ranked WHERE score >= 16""",
    "llms_links": rf"""WITH {_DOCS} SELECT pos, 'the guide' AS title, concat('guide-', cast(pos AS string), '.md') AS url, 'how it works' AS description FROM docs WHERE pos % 5 = 1
UNION ALL SELECT pos, concat(cast(pos AS string), '.txt'), concat('https://docs.example.com/raw/', cast(pos AS string), '.txt'), NULL FROM docs WHERE pos % 6 = 2
UNION ALL SELECT pos, regexp_extract(url, '([^/]*)$', 1), url, NULL FROM (SELECT DISTINCT doc_id AS pos, regexp_replace(unnest(regexp_extract_all(text, '(?:^|\s)(?:Raw:)?\s*(https?://\S+)', 1)), '[),.;]+$', '') AS url FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)""",
    "chunk_markdown": rf"""WITH {_DOCS}, s AS (SELECT pos, path, string_split(regexp_replace(regexp_replace(raw, '\A---\n[\s\S]*?\n---\n?', ''), '\n(##?\s+)', chr(1) || '\1', 'g'), chr(1)) AS sections FROM docs),
e AS (SELECT pos, path, unnest(sections) AS section, generate_subscripts(sections, 1) - 1 AS ordinal FROM s),
t AS (SELECT *, coalesce(nullif(trim(regexp_extract(section, '(?m)^title:\s*(.+)$', 1)), ''), nullif(trim(regexp_extract(section, '(?m)^https?://\S+/([^/\s]+)$', 1)), ''), nullif(trim(regexp_extract(section, '(?m)^#+\s+(.+)$', 1)), ''), regexp_extract(path, '([^/]+)\.md$', 1)) AS title FROM e)
SELECT concat('s', cast(pos % 3 AS string), ':federated:', coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), cast(ordinal AS string))) AS "chunkKey", path, title, left(trim(section, ' ' || chr(9) || chr(10) || chr(13)), 500) AS summary, CAST(ordinal AS BIGINT) AS ordinal FROM t""",
    "hybrid_retrieve": rf"""WITH {_FOUND}, local AS ({_CHUNKS}), fed AS (
  SELECT query_id, concat('web:federated:', cast(page_id % 90 AS string)) AS "chunkKey", url AS path, page_id AS spot, CAST(list_sum(list_transform(list_filter(string_split_regex(lower(term), '[^a-z0-9]+'), lambda t: length(t) >= 2), lambda t: CASE WHEN contains(lower(concat('page ', cast(page_id AS string), ' ', html, ' ', url)), t) THEN length(t) ELSE 0 END)) AS BIGINT) AS score
  FROM pages, terms WHERE page_id IS NOT NULL AND url IS NOT NULL
), every_one AS (SELECT query_id, "chunkKey", type, path, score, 0 AS side, rank AS spot FROM local UNION ALL SELECT query_id, "chunkKey", 'federated', path, score, 1, spot FROM fed WHERE score > 0),
one AS (SELECT *, min((side, spot)) OVER (PARTITION BY query_id, "chunkKey") AS place FROM every_one QUALIFY row_number() OVER (PARTITION BY query_id, "chunkKey" ORDER BY score DESC, side, spot) = 1)
SELECT CAST(query_id AS BIGINT) AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank, "chunkKey", type, path, score FROM one QUALIFY rank <= 8""",
    "content_hash": """SELECT doc_id, sha256(concat('{"id":', doc_id, ',"meta":{"a":["', doc_id % 3, '","é/\\""],"lang":', to_json(lang), '},"source":', to_json(source), ',"text":', to_json(text), '}')) AS sha256 FROM documents""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, round(s, 6) AS similarity FROM s QUALIFY rank <= 6""",
    "fixed_chunks": """WITH s AS (SELECT doc_id AS id, text, unnest(range(0, greatest(0, length(text) - 121) + 1, 780)) AS off FROM documents WHERE length(text) > 0) SELECT id, CAST(off / 780 AS BIGINT) AS ordinal, substring(text, off + 1, 900) AS chunk FROM s""",
    "debounce_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "link_graph_violations": """WITH p AS (
  SELECT n_nationkey AS k, concat('n', n_nationkey) AS id, concat('org/n', n_nationkey) AS repo, CASE WHEN n_nationkey % 6 <> 1 THEN 'home' END AS home, CASE WHEN n_nationkey % 4 <> 0 AND n_nationkey % 6 <> 1 THEN 'docs' END AS docs, concat('https://stats/n', n_nationkey) AS stats, n_nationkey % 5 = 0 AS fuma, n_nationkey % 2 = 0 AS bar, CASE WHEN n_nationkey % 7 <> 3 THEN n_nationkey % 20 END AS o,
    [concat('n', n_nationkey * 2), concat('n', n_regionkey), concat('n', n_nationkey + 1)] AS nxt FROM nation
), e AS (SELECT id, unnest(nxt) AS to_id FROM p), c AS (
  SELECT n_nationkey AS k, concat('n', CASE WHEN n_nationkey = 7 THEN 77 ELSE n_nationkey END) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'endpoint' ELSE 'repository' END AS type, CASE WHEN n_nationkey <> 10 THEN concat('https://stats/n', n_nationkey) END AS url, CASE WHEN n_nationkey <> 9 THEN concat('org/n', n_nationkey) END AS repo FROM nation WHERE n_nationkey <> 4
), j AS (SELECT c.*, p.repo AS p_repo, p.stats AS p_stats FROM c JOIN p USING (id)), x AS (SELECT j.*, unnest(CASE WHEN k % 5 = 1 THEN [1, 2] ELSE [1] END) AS copy FROM j)
SELECT 'docs-surface-required' AS rule, id AS key, CAST(NULL AS VARCHAR) AS detail FROM p WHERE fuma AND docs IS NULL
UNION ALL SELECT 'bar-needs-home-and-order', id, NULL FROM p WHERE bar AND (home IS NULL OR o IS NULL)
UNION ALL SELECT 'bar-order-unique', CAST(o AS VARCHAR), NULL FROM p WHERE bar AND o IS NOT NULL GROUP BY o HAVING count(*) > 1
UNION ALL SELECT 'navigation-self', id, NULL FROM e WHERE id = to_id
UNION ALL SELECT 'navigation-duplicate', id, to_id FROM e GROUP BY id, to_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'navigation-unknown', id, to_id FROM e WHERE to_id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'claims-missing', id, NULL FROM p WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'claims-unknown', id, NULL FROM c WHERE id NOT IN (SELECT id FROM p)
UNION ALL SELECT 'source-endpoint', id, NULL FROM j WHERE type = 'endpoint' AND url IS DISTINCT FROM p_stats
UNION ALL SELECT 'source-repository', id, NULL FROM j WHERE type = 'repository' AND repo IS DISTINCT FROM p_repo
UNION ALL SELECT 'declared-has-claims', id, NULL FROM j WHERE k % 8 = 0
UNION ALL SELECT 'claim-unique', id, 'c' FROM x GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'claim-floor', id, 'c' FROM x WHERE k % 3 = 0 AND k < 10
UNION ALL SELECT 'claim-evidence', id, 'c' FROM x WHERE concat('org/n', k % 11) <> p_repo""",
    "llms_txt": rf"""WITH {_KNOW}, t AS (SELECT pos, concat('- [', title, '](', path, ')', CASE WHEN description <> '' THEN concat(': ', description) ELSE '' END) AS item FROM know ORDER BY pos LIMIT 500)
SELECT concat('# demo', chr(10), chr(10), '> Agent-readable documentation index.', chr(10), chr(10), '## Knowledge', chr(10), chr(10), string_agg(item, chr(10) ORDER BY pos), chr(10)) AS content FROM t""",
    "default_checks": f"""WITH d AS ({_DISCOVERED}), t AS (SELECT pos, coalesce(name, id) AS t FROM d)
SELECT pos, 'npm' AS manager, concat('npm test -w ', t, ',npm run lint -w ', t) AS checks FROM t UNION ALL SELECT pos, 'pnpm', concat('pnpm --filter ', t, ' test,pnpm --filter ', t, ' lint') FROM t
UNION ALL SELECT pos, 'yarn', concat('yarn workspace ', t, ' test,yarn workspace ', t, ' lint') FROM t UNION ALL SELECT pos, 'bun', 'bun test,bun run lint' FROM t""",
    "vitepress_routes": rf"""WITH {_PAGES} SELECT regexp_extract(path, '([^/]+)\.md$', 1) AS id, concat('/guide/', CASE WHEN path LIKE '%/index.md' THEN regexp_replace(path, '/index\.md$', '') ELSE regexp_replace(path, '\.md$', '.html') END) AS url, concat('docs/', path) AS path FROM page""",
    "knowledge_urls": rf"""WITH {_KNOW} SELECT pos, concat('https://docs.example.com/base/', regexp_replace(regexp_replace(path, '\.md$', ''), '^docs/', '')) AS url FROM know""",
}
