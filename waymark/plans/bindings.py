"""Input tables of the named queries, as SQL that both Spark and DuckDB run over the same Parquet tables.

The given tables hold no Markdown and no package metadata, so the structure is put around their texts here.
"""

from __future__ import annotations

NL = "chr(10)"
_ID = "cast(doc_id as string)"

#: (pos, path, raw): agent documents with frontmatter, headings, links, tables, fences and stale words on some.
AGENT_DOCS = f"""
SELECT doc_id AS pos,
  concat('docs/for-agents/', CASE doc_id % 4 WHEN 0 THEN 'packages/' WHEN 1 THEN 'pillars/core/' WHEN 2 THEN '' ELSE 'notes/' END, 'd', {_ID}, '.md') AS path,
  concat(
    CASE WHEN doc_id % 7 = 6 THEN '' ELSE concat('---', {NL}, 'id: doc-', {_ID}, {NL},
      CASE WHEN doc_id % 3 = 0 THEN concat('purpose: "About ', source, '"', {NL}) ELSE '' END,
      CASE WHEN doc_id % 5 <> 4 THEN concat('type: ', CASE WHEN doc_id % 5 = 3 THEN 'draft' ELSE 'guide' END, {NL}) ELSE '' END,
      CASE WHEN doc_id % 8 = 0 THEN concat('package: p', {_ID}, {NL}, 'editRoot: src/p', {_ID}, {NL}) ELSE '' END,
      CASE WHEN doc_id % 4 = 1 THEN concat('owner: team-', lang, {NL}) ELSE '' END,
      CASE WHEN doc_id % 9 = 2 THEN concat('humanDoc: /docs/h', {_ID}, {NL}) ELSE '' END,
      CASE WHEN doc_id % 10 = 3 THEN concat('checks: [lint, "test"]', {NL}) ELSE '' END, '---', {NL}) END,
    CASE WHEN doc_id % 6 = 5 THEN '' ELSE concat('# ', lang, ' document ', {_ID}, {NL}, {NL}) END,
    CASE WHEN doc_id % 4 = 2 THEN concat('| a | b |', {NL}, '|---|---|', {NL}, {NL}) ELSE '' END,
    CASE WHEN doc_id % 5 = 1 THEN concat('See [the guide](guide-', {_ID}, '.md): how it works', {NL}, {NL}) ELSE '' END,
    text, {NL}, {NL},
    CASE WHEN doc_id % 4 = 0 THEN concat('## Purpose', {NL}, 'It serves ', source, '.', {NL}) ELSE '' END,
    CASE WHEN doc_id % 3 = 1 THEN concat('## Examples', {NL}, '```', {NL}, 'run it', {NL}, '```', {NL}) ELSE '' END,
    CASE WHEN doc_id % 11 = 4 THEN concat('TODO: finish this', {NL}) ELSE '' END,
    CASE WHEN doc_id % 6 = 2 THEN concat('Raw: https://docs.example.com/raw/', {_ID}, '.txt', {NL}) ELSE '' END
  ) AS raw
FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
"""

#: (id, type, title, description, path, body, pos): a plain knowledge table.
KNOWLEDGE = f"""
SELECT concat('doc-', {_ID}) AS id, 'agent-doc' AS type, concat(lang, ' ', source) AS title, substring(text, 1, 120) AS description,
  concat('docs/d', cast(doc_id % 500 as string), '.md') AS path, text AS body, doc_id AS pos
FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
"""

#: Owners with and without a document of their own; some share a path with knowledge.
OWNERSHIP = """
SELECT concat('s-', cast(s_suppkey as string)) AS id, concat('packages/s', cast(s_suppkey as string)) AS path,
  n_name AS "group", CASE WHEN s_suppkey % 3 = 0 THEN 'core' END AS layer, concat(s_name, ' serves ', lower(n_name)) AS purpose,
  CASE WHEN s_suppkey % 4 <> 1 THEN concat('docs/d', cast((s_suppkey * 7) % 500 as string), '.md') END AS agent_doc,
  CASE s_suppkey % 3 WHEN 0 THEN concat('/docs/s', cast(s_suppkey as string)) WHEN 1 THEN concat('https://docs.example.com/', cast(s_suppkey as string)) END AS human_doc,
  s_suppkey AS pos
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

#: A stated set of terms: the first two words of each of the benchmark's texts, and some that ask for owners or name ids.
TERMS = """
SELECT item_id AS query_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS term FROM benchmark WHERE text IS NOT NULL
UNION ALL SELECT 100001, 'where do I edit package s-7' UNION ALL SELECT 100002, 's-3' UNION ALL SELECT 100003, 'doc-12 the'
UNION ALL SELECT 100004, 'supplier#000000005 france' UNION ALL SELECT 100005, '! a ?' UNION ALL SELECT 100006, 'the the owner'
"""

#: Notes whose words reach every route.
NOTES = """
SELECT concat(cast(conv_id as string), '-', cast(turn as string)) AS id, conv_id * 1000 + turn AS pos,
  concat(CASE (conv_id * 3 + turn) % 7 WHEN 0 THEN 'Please ignore this. ' WHEN 1 THEN 'A pattern: ' WHEN 2 THEN concat('The package s-', cast(conv_id % 30 as string), ' owns this. ') WHEN 3 THEN 'See the tutorial. '
    WHEN 4 THEN concat('module core/x-', cast(turn as string), ' routes calls. ') WHEN 5 THEN concat('token = abc', cast(turn as string), ' ') ELSE 'Mail joe@mail.example.com or ann@example.com. ' END, text) AS fact
FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL
"""

#: Human pages in the order of their ids: some ids and routes repeat.
PAGES = """
SELECT concat('h', cast(page_id % 150 as string)) AS id, concat('/docs/s', cast(page_id % 120 as string)) AS url,
  concat(CASE page_id % 5 WHEN 4 THEN 'docs/for-agents/' WHEN 3 THEN 'site/for-agents/' ELSE 'site/' END, 'p', cast(page_id as string), CASE WHEN page_id % 7 = 0 THEN '/index.md' ELSE '.md' END) AS path, page_id AS pos
FROM pages WHERE page_id IS NOT NULL
"""


#: Identifiers that need quotes.
QUOTED = ("group", "chunkKey", "ruleId")


def spark_sql(text: str) -> str:
    """The same statement for Spark: its identifiers are quoted by backticks."""
    for name in QUOTED:
        text = text.replace(f'"{name}"', f"`{name}`")
    return text
