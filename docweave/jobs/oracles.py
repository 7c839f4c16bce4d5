"""DuckDB SQL for the registered queries. The corpus is made by the adapter's expressions; expected edges and
findings follow from the ids by which the adapter chose the lines, not from parsing.
"""

from __future__ import annotations

import re

from docweave.jobs import adapter as A
from docweave.jobs.queries import ALLOW, ALLOW_REGEX, REGEX, TERMS

PIECES = ", ".join(A.PIECES)
#: d: all corpus documents; t: tracked ones; fm: with a well-formed block; p: every existing path of a repository.
CORPUS = f"""
d AS (SELECT *, q % 17 <> 16 AS tracked, concat_ws(chr(10), {PIECES}) AS content FROM (SELECT {", ".join(A.corpus_columns()).replace("text,", "coalesce(text, '') AS text,", 1)} FROM documents)),
t AS (SELECT * FROM d WHERE tracked),
fm AS (SELECT * FROM t WHERE q % 3 <> 0 AND q % 23 <> 5),
code AS (SELECT DISTINCT repo, q % 5 AS m, 'src/m' || (q % 5) || '/f' || doc_id || '.go' AS path, 'OldWidget' || (q % 25) AS name FROM d WHERE q % 12 = 3),
ce AS (SELECT t.repo, t.path AS src, t.down AS dst, 'link' AS kind FROM t JOIN t x ON x.repo = t.repo AND x.path = t.down WHERE t.q % 4 < 3 AND t.path <> t.down
       UNION SELECT t.repo, t.path, t.far, 'mention' FROM t JOIN t x ON x.repo = t.repo AND x.path = t.far WHERE t.q % 5 < 2
       UNION SELECT t.repo, t.path, t.down, 'mention' FROM t JOIN t x ON x.repo = t.repo AND x.path = t.down WHERE t.q % 4 < 3 AND t.doc_id < 40),
re AS (SELECT repo, path AS src, up AS dst, 'part-of' AS rel, '' AS note FROM fm UNION ALL SELECT repo, path, far, 'see-also', 'same' FROM fm WHERE q % 7 = 3),
me AS (SELECT DISTINCT re.* FROM re JOIN t x ON x.repo = re.repo AND x.path = re.dst WHERE re.src <> re.dst),
cv AS (SELECT repo, path AS doc, 'src/m' || (q % 10) AS target FROM fm),
be AS (SELECT re.repo, re.src AS path, re.rel, re.dst AS target FROM re LEFT JOIN d x ON x.repo = re.repo AND x.path = re.dst WHERE x.path IS NULL
       UNION ALL SELECT cv.repo, doc, 'covers', target FROM cv LEFT JOIN (SELECT DISTINCT repo, 'src/m' || m AS f FROM code) c ON c.repo = cv.repo AND c.f = target WHERE c.f IS NULL),
bl AS (SELECT d.repo, d.path, d.content[:strpos(d.content, '[next](')] AS before, d.down AS target FROM t d LEFT JOIN d x ON x.repo = d.repo AND x.path = d.down WHERE d.q % 4 < 3 AND x.path IS NULL
       UNION ALL SELECT repo, path, content[:strpos(content, '[gone](')], regexp_replace(path, '[^/]*$', '') || 'gone-' || doc_id || '.md' FROM t WHERE q % 6 = 2),
lo AS (SELECT repo, path FROM fm EXCEPT SELECT repo, src FROM me EXCEPT SELECT repo, dst FROM me),
op AS (SELECT repo, path FROM t WHERE path NOT IN ('README.md', 'CLAUDE.md') EXCEPT SELECT repo, dst FROM ce),
ff AS (SELECT repo, path, CASE WHEN q % 3 <> 0 AND q % 23 = 5 THEN 'malformed' WHEN q % 3 = 0 THEN CASE WHEN path <> 'README.md' THEN 'missing' END WHEN q % 5 > 2 THEN 'no type' END AS problem FROM t),
arc AS (SELECT fm.repo, fm.path AS src, fm.up AS dst FROM fm JOIN t x ON x.repo = fm.repo AND x.path = fm.up),
reach AS (SELECT repo, src, dst FROM arc UNION SELECT r.repo, r.src, a.dst FROM reach r JOIN arc a ON a.repo = r.repo AND a.src = r.dst),
cy AS (SELECT DISTINCT repo, src AS path FROM reach WHERE src = dst)
"""
DIFF = """
pd AS (SELECT p_partkey AS k, p_size, 'r' || (p_partkey % 20) AS repo, 'g' || (CAST(floor(p_partkey / 20) AS BIGINT) % 40) AS range_id, 'src/p' || p_partkey || CASE WHEN p_partkey % 10 = 9 THEN '.md' ELSE '.go' END AS path FROM part),
pc AS (SELECT * FROM pd WHERE k % 10 <> 9),
rs AS (SELECT repo, range_id, 'OldWidget' || (k % 50) AS name FROM pc GROUP BY ALL HAVING NOT bool_or(k % 3 = 0)),
cc AS (SELECT * FROM (SELECT repo, range_id, 'MAX_ITEMS_' || w AS name, CAST(w + 10 AS STRING) AS old, CAST(arg_max(p_size + 100, k) AS STRING) AS new FROM (SELECT *, k % 50 AS w FROM pc) GROUP BY repo, range_id, w) WHERE old <> new)
"""


def corpus_sql(select: str, *more: str) -> str:
    return f"WITH RECURSIVE {', '.join([CORPUS.strip(), *[m.strip() for m in more]])} {select}"


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def quoted(term: str) -> str:
    return "(?i)" + re.sub(r"([^\w\s])", r"\\\1", term)


def leak_sql(table: str, key: str, text: str, rules=None, where: str = "true", allow=None, name: str = "") -> str:
    """Spans of each rule on each line by the lengths between matches; deny spans inside an allow span go."""
    deny = rules or [(quoted(x), x) for x in TERMS] + [("(?i)" + x, x) for x in REGEX]
    allow = allow if allow is not None else [(quoted(x), "true") for x in ALLOW] + [("(?i)" + x, "true") for x in ALLOW_REGEX]

    def spans(pattern: str, rule: str, cond: str = "true") -> str:
        p = literal(pattern)
        return f"""SELECT {key}, line, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, m[i] AS match, {literal(rule)} AS rule
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, string_split_regex(t, {p}) AS s, regexp_extract_all(t, {p}) AS m FROM l WHERE regexp_matches(t, {p}) AND {cond}))"""

    return f"""WITH {name} l AS (SELECT * EXCLUDE (ts), ts[line] AS t FROM (SELECT *, unnest(range(1, len(ts) + 1))::INT AS line FROM (SELECT *, string_split({text}, chr(10)) AS ts FROM {table} WHERE {where}))),
        dn AS ({" UNION ".join(spans(p, r) for p, r in deny)}), al AS ({" UNION ".join(spans(p, "", c) for p, c in allow)})
        SELECT {key}, line, start::INT AS start, match, rule FROM dn WHERE NOT EXISTS (SELECT 1 FROM al WHERE {" AND ".join(f"al.{k.strip()} = dn.{k.strip()}" for k in key.split(","))} AND al.line = dn.line AND al.start <= dn.start AND al.start + length(al.match) >= dn.start + length(dn.match))"""


def redaction_sql() -> str:
    out = "text"
    for p in [quoted(x) for x in TERMS] + ["(?i)" + x for x in REGEX]:
        out = f"regexp_replace({out}, {literal(p)}, '***REMOVED***', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


CHANGES = f"""
ch AS (SELECT DISTINCT 'r' || (l_orderkey % 20) AS repo, 'g' || (l_orderkey % 100) AS range_id,
       CASE WHEN l_linenumber % 3 = 0 THEN {A.PATH.format(i="(l_partkey * 20 + l_orderkey % 20)")} ELSE 'src/m' || (l_partkey % 10) || '/f' || l_suppkey || '.go' END AS path, l_linenumber % 3 <> 0 AS is_code, 'src/m' || (l_partkey % 10) AS folder FROM lineitem)
"""
DOCS = "(SELECT repo, path, row_number() OVER () AS n FROM d)"
USES = """
us AS (SELECT repo, path, q % 50 AS w, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, 'Uses OldWidget' || (q % 50) || ' and MAX_ITEMS_' || (q % 50) || ' of ' || (q % 50 + 10) AS text
       FROM (SELECT *, content[:strpos(content, 'Uses OldWidget')] AS before FROM d WHERE q % 9 = 1))
"""
KIND = "CASE q % 5 WHEN 0 THEN 'runbook' WHEN 1 THEN 'guide' WHEN 2 THEN 'recipe' ELSE '(untyped)' END"
TITLE = "CASE WHEN q % 4 <> 1 THEN 'Doc ' || doc_id END"
HEADING = "CASE WHEN q % 2 = 0 THEN 'Heading ' || doc_id ELSE '' END"
NEAREST = """
cand AS (SELECT 'u' || user_id AS repo, 'h' || event_id AS head, ord, 'c' || (event_id + ord) AS base, (event_id * 7 + ord * 5) % 4 AS n FROM events, (VALUES (0), (1), (2)) o(ord) WHERE event_id % 13 <> 12),
nb AS (SELECT repo, head, arg_min(base, n * 10 + ord) AS base FROM cand GROUP BY repo, head)
"""

ORACLES: dict[str, str] = {
    "leak_findings": leak_sql("documents", "doc_id", "text"),
    "leak_findings_pages": leak_sql("pages", "page_id", "html"),
    "leak_dir_scoped": leak_sql(
        "fl", "repo, path", "content",
        rules=[("(?i)Footgun", "Footgun"), ("(?i)OldWidget[0-9]+", "OldWidget[0-9]+")],
        allow=[("(?i)OldWidget1", "path LIKE 'docs/s3/%'"), (r"(?i)> \*\*footgun", "path LIKE 'docs/s4/%'")],
        where="NOT regexp_matches(path, '/d[^/]*7[.]md$') AND NOT regexp_matches(path, '^docs/.*/?d[^/]*1[.]md$')",
        name=f"{CORPUS.strip().split('t AS (SELECT')[0].rstrip().rstrip(',')}, fl AS (SELECT repo, path, content FROM d UNION ALL SELECT repo, 'src/m' || (q % 5) || '/f' || doc_id || '.go', 'type OldWidget' || (q % 25) || ' struct {{}}' FROM d WHERE q % 12 = 3),",
    ),
    "redacted_text": redaction_sql(),
    "content_edges": corpus_sql("SELECT * FROM ce"),
    # by brute force over the texts: every body against every path of its repository
    "mention_edges": corpus_sql(
        "SELECT DISTINCT b.repo, b.path AS src, x.path AS dst, 'mention' AS kind FROM bodies b JOIN t x ON x.repo = b.repo AND x.path <> b.path WHERE contains(b.body, x.path) AND regexp_matches(b.body, '(^|[^A-Za-z0-9./_-])' || regexp_escape(x.path))",
        f"bodies AS (SELECT repo, path, concat_ws(chr(10), {', '.join(A.PIECES[13:])}) AS body FROM t)",
    ),
    "orphans_by_repo": corpus_sql(
        """SELECT repo, path FROM nd WHERE path NOT IN ('README.md', 'CLAUDE.md') AND NOT (repo = 'r1' AND path = 'docs/s2/d41.md') AND NOT (repo = 'r3' AND path = 'docs/s2/d43.md')
           EXCEPT SELECT ce.repo, dst FROM ce JOIN nd ON nd.repo = ce.repo AND nd.path = ce.src WHERE kind = 'link'
           EXCEPT SELECT ce.repo, dst FROM ce JOIN nd ON nd.repo = ce.repo AND nd.path = ce.src WHERE kind = 'mention'""",
        """nd AS (SELECT repo, path FROM t WHERE NOT (repo = 'r1' AND (path LIKE 'docs/s1/%' OR regexp_matches(path, '(^|/)d[^/]*3[.]md$'))) AND NOT (repo = 'r2' AND regexp_matches(path, '^docs/[^/]*/d[^/][0-4][^/]*[.]md$')))""",
    ),
    "orphans_at_ref": corpus_sql("SELECT * FROM op").replace("FROM d WHERE tracked)", "FROM d WHERE tracked AND (doc_id < 40 OR doc_id % 3 <> 0))"),
    "leak_by_repo": leak_sql(
        "fl", "repo, path", "content",
        rules=[("(?i)Footgun", "Footgun"), ("(?i)OldWidget[0-9]+", "OldWidget[0-9]+"), ("(?i)MAX_ITEMS_([0-9]+)", "MAX_ITEMS_(?P<n>[0-9]+)")],
        allow=[("(?i)OldWidget1", "repo = 'r2' AND path LIKE 'docs/s3/%'"), (r"(?i)MAX_ITEMS_3", "repo = 'r3' AND path LIKE 'docs/%'")],
        name=f"{CORPUS.strip().split('t AS (SELECT')[0].rstrip().rstrip(',')}, fl AS (SELECT repo, path, content FROM d UNION ALL SELECT repo, 'src/m' || (q % 5) || '/f' || doc_id || '.go', 'type OldWidget' || (q % 25) || ' struct {{}}' FROM d WHERE q % 12 = 3),",
    ) + " AND (rule = 'MAX_ITEMS_(?P<n>[0-9]+)' OR (rule = 'Footgun' AND repo = 'r1') OR (rule = 'OldWidget[0-9]+' AND repo = 'r2'))",
    "leak_rule_table": f"""WITH {CORPUS.strip().split('t AS (SELECT')[0].rstrip().rstrip(',')}, fl AS (SELECT repo, path, content FROM d UNION ALL SELECT repo, 'src/m' || (q % 5) || '/f' || doc_id || '.go', 'type OldWidget' || (q % 25) || ' struct {{}}' FROM d WHERE q % 12 = 3),
        l AS (SELECT repo, path, line, ts[line] AS t FROM (SELECT *, unnest(range(1, len(ts) + 1))::INT AS line FROM (SELECT repo, path, string_split(content, chr(10)) AS ts FROM fl))),
        rl AS (SELECT DISTINCT 'r' || (p_partkey % 20) AS repo, 'OldWidget' || (p_partkey % 50) AS raw, '' AS folder, true AS deny FROM part
               UNION SELECT 'r' || (p_partkey % 20), 'OldWidget' || (p_partkey % 50), 'docs/s' || (p_partkey % 7) || '/', false FROM part WHERE p_partkey % 9 = 0),
        m AS (SELECT l.*, raw, deny, string_split(lower(t), lower(raw)) AS s FROM l JOIN rl ON rl.repo = l.repo AND starts_with(path, folder) AND contains(lower(t), lower(raw))),
        sp AS (SELECT *, (list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * length(raw))::INT AS start FROM (SELECT *, unnest(range(1, len(s))) AS i FROM m))
        SELECT DISTINCT repo, path, line, start, substr(t, start + 1, length(raw)) AS match, raw AS rule FROM sp x
        WHERE deny AND NOT EXISTS (SELECT 1 FROM sp y WHERE NOT y.deny AND y.repo = x.repo AND y.path = x.path AND y.line = x.line AND y.start <= x.start AND y.start + length(y.raw) >= x.start + length(x.raw))""",
    "in_degree": corpus_sql("SELECT repo, dst AS path, count(*) AS n_in FROM ce GROUP BY ALL"),
    "orphans": corpus_sql("SELECT * FROM op"),
    "broken_links": corpus_sql("SELECT repo, path, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, target FROM bl"),
    "broken_edges": corpus_sql("SELECT * FROM be"),
    "frontmatter_findings": corpus_sql("SELECT * FROM ff WHERE problem IS NOT NULL"),
    "frontmatter_docs": corpus_sql(
        f"""SELECT repo, path, CASE WHEN q % 5 > 2 THEN '' ELSE {KIND} END AS type, coalesce({TITLE}, '') AS title, CASE WHEN q % 4 = 2 THEN 'about it' ELSE '' END AS description, '2025-0' || (q % 9 + 1) || '-15' AS verified,
        CASE WHEN q % 2 = 0 THEN CASE q % 6 WHEN 0 THEN '90d' WHEN 2 THEN '2w' ELSE 'soon' END ELSE '' END AS review, {HEADING} AS heading, (2 + (q % 7 = 3)::INT + (q % 11 = 4)::INT)::INT AS n_links FROM fm"""
    ),
    "untracked": corpus_sql("SELECT repo, path FROM d WHERE NOT tracked"),
    "metadata_edges": corpus_sql("SELECT * FROM me"),
    "metadata_degree": corpus_sql("SELECT repo, path, count(*) AS degree FROM (SELECT repo, src AS path FROM me UNION ALL SELECT repo, dst FROM me) GROUP BY ALL"),
    "disconnected": corpus_sql("SELECT * FROM lo"),
    "cycle_members": corpus_sql("SELECT * FROM cy"),
    "cross_refs": corpus_sql("SELECT * FROM me WHERE rel <> 'part-of'"),
    "part_of_tree": corpus_sql(
        "SELECT repo, root, path, depth, trail FROM tr",
        """tr AS (SELECT repo, path AS root, path, 0 AS depth, path AS trail FROM (SELECT repo, path FROM fm EXCEPT SELECT repo, src FROM me WHERE rel = 'part-of')
           UNION ALL SELECT tr.repo, tr.root, me.src, depth + 1, trail || ' > ' || me.src FROM tr JOIN me ON me.repo = tr.repo AND me.dst = tr.path AND rel = 'part-of' WHERE NOT list_contains(string_split(trail, ' > '), me.src))""",
    ),
    "doc_index": corpus_sql(f"SELECT repo, {KIND} AS type, CASE q % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 99 END::INT AS rank, coalesce({TITLE}, nullif({HEADING}, ''), path) AS label, path, CASE WHEN q % 4 = 2 THEN 'about it' ELSE '' END AS description FROM fm"),
    "index_markdown": corpus_sql(
        f"""SELECT repo, string_agg('## ' || type || chr(10) || body, chr(10) || chr(10) ORDER BY rank, type) AS text FROM
        (SELECT repo, {KIND} AS type, CASE q % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 99 END AS rank, string_agg('- [' || coalesce({TITLE}, nullif({HEADING}, ''), path) || '](' || path || ')' || CASE WHEN q % 4 = 2 THEN ' - about it' ELSE '' END, chr(10) ORDER BY path) AS body FROM fm GROUP BY 1, 2, 3) GROUP BY repo"""
    ),
    "stale_docs": corpus_sql(
        """SELECT * FROM (SELECT repo, path, '2025-0' || (q % 9 + 1) || '-15' AS verified, date_diff('day', ('2025-0' || (q % 9 + 1) || '-15')::DATE, DATE '2026-01-01')::INT AS age,
        CASE WHEN q % 6 = 0 THEN 90 WHEN q % 6 = 2 THEN 14 ELSE 180 END::INT AS threshold FROM fm) WHERE age > threshold"""
    ),
    "covers_of": corpus_sql("SELECT DISTINCT ch.repo, ch.path, cv.doc FROM ch JOIN cv ON cv.repo = ch.repo AND ch.is_code AND cv.target = ch.folder", CHANGES),
    "covers_drift": corpus_sql(
        """SELECT repo, doc, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM (SELECT ch.repo, ch.range_id, ch.path, cv.doc FROM ch JOIN cv ON cv.repo = ch.repo AND ch.is_code AND cv.target = ch.folder) h
        WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.repo = h.repo AND x.range_id = h.range_id AND x.path = h.doc) GROUP BY repo, doc""",
        CHANGES,
    ),
    "covers_drift_paths": corpus_sql(
        """SELECT DISTINCT ch.repo, cv.doc, ch.path FROM ch JOIN cv ON cv.repo = ch.repo AND ch.is_code AND cv.target = ch.folder
        WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.repo = ch.repo AND x.range_id = ch.range_id AND x.path = cv.doc)""",
        CHANGES,
    ),
    "graph_lines": corpus_sql(
        """SELECT repo, section, pos, CASE WHEN pos > 0 THEN ',' ELSE '' END || text AS text FROM (SELECT repo, section, row_number() OVER (PARTITION BY repo, section ORDER BY k0, k1, k2, k3 NULLS FIRST) - 1 AS pos, text FROM el)
        UNION ALL SELECT repo, s.section, 0, CASE WHEN s.section = 0 THEN '{"schemaVersion":1,"repoRoot":"' || repo || '","nodes":[' ELSE s.text END FROM (SELECT DISTINCT repo FROM d), (VALUES (0, ''), (2, '],"contentEdges":['), (4, '],"metadataEdges":['), (6, '],"islands":{"content":['), (8, '],"metadata":['), (10, ']}}')) s(section, text)""",
        f"""js AS (SELECT t.repo, t.path, fm.path IS NOT NULL AS f, nullif(CASE WHEN t.q % 5 > 2 THEN '' ELSE {KIND} END, '') AS kind, nullif(coalesce({TITLE}, ''), '') AS title, nullif({HEADING}, '') AS heading, t.q % 4 = 2 AS about
               FROM t LEFT JOIN (SELECT repo AS r, path FROM fm) fm ON fm.r = t.repo AND fm.path = t.path),
           el AS (SELECT repo, 1 AS section, path AS k0, '' AS k1, '' AS k2, '' AS k3, '{{"path":' || to_json(path) || ',"hasFrontmatter":' || f || CASE WHEN f THEN coalesce(',"type":' || to_json(kind), '') || coalesce(',"title":' || to_json(title), '') || CASE WHEN about THEN ',"description":"about it"' ELSE '' END || coalesce(',"heading":' || to_json(heading), '') ELSE '' END || '}}' AS text FROM js
           UNION ALL SELECT repo, 3, src, dst, kind, '', '{{"from":' || to_json(src) || ',"to":' || to_json(dst) || ',"kind":"' || kind || '"}}' FROM ce
           UNION ALL SELECT repo, 5, src, dst, rel, nullif(note, ''), '{{"from":' || to_json(src) || ',"to":' || to_json(dst) || ',"rel":"' || rel || '"' || CASE WHEN note = '' THEN '' ELSE ',"note":' || to_json(note) END || '}}' FROM me
           UNION ALL SELECT repo, 7, path, '', '', '', to_json(path) FROM op UNION ALL SELECT repo, 9, path, '', '', '', to_json(path) FROM lo)""",
    ),
    "index_lines": corpus_sql(
        """SELECT repo, rank, type, row_number() OVER (PARTITION BY repo, rank, type ORDER BY path) AS pos, text FROM ix
        UNION ALL SELECT DISTINCT repo, rank, type, 0, '## ' || type FROM ix UNION ALL SELECT DISTINCT repo, rank, type, -1, '' FROM ix WHERE (rank, type) <> (SELECT (min(rank), arg_min(type, (rank, type))) FROM ix x WHERE x.repo = ix.repo)""",
        f"""ix AS (SELECT repo, {KIND} AS type, CASE q % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 99 END::INT AS rank, path, '- [' || coalesce({TITLE}, nullif({HEADING}, ''), path) || '](' || path || ')' || CASE WHEN q % 4 = 2 THEN ' - about it' ELSE '' END AS text FROM fm)""",
    ),
    "audit_summary": corpus_sql(
        """SELECT r.repo, r.n AS tracked_md, r.n AS nodes, (SELECT count(*) FROM op WHERE op.repo = r.repo) AS orphans, (SELECT count(*) FROM bl WHERE bl.repo = r.repo) AS broken, (SELECT count(*) FROM d WHERE d.repo = r.repo AND NOT tracked) AS untracked,
        (SELECT count(*) FROM ff WHERE ff.repo = r.repo AND problem IS NOT NULL) AS frontmatter, (SELECT count(*) FROM be WHERE be.repo = r.repo) + (SELECT count(*) FROM cy WHERE cy.repo = r.repo) // 2 AS edges,
        (SELECT count(*) FROM lo WHERE lo.repo = r.repo) AS disconnected, r.n - (SELECT count(*) FROM op WHERE op.repo = r.repo) AS reachable FROM (SELECT repo, count(*) AS n FROM t GROUP BY repo) r"""
    ),
    "diff_paths": f"""WITH {DIFF} SELECT repo, range_id, path, (9 + CASE WHEN k % 11 = 5 THEN 2 WHEN k % 7 = 3 THEN 1 ELSE 0 END + 1)::BIGINT AS n_lines, (3 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_plus, 3::BIGINT AS n_minus FROM pd
        UNION ALL SELECT repo, range_id, 'moved' || k || '.md', 4, 0, 0 FROM pd WHERE k % 13 = 4""",
    "removed_symbols_texts": f"WITH {DIFF} SELECT * FROM rs",
    # a line of the new file stands in front of the footgun's: the kept or added one, and one that looks like a header; a deleted file has no new lines, yet its text is read
    "footgun_added_texts": f"WITH {DIFF} SELECT DISTINCT repo, path, (10 + k % 90 + 2)::INT AS line, '# footgun: new' AS text FROM pd WHERE k % 4 <> 0",
    "removed_symbols": f"WITH {DIFF} SELECT * FROM rs",
    "changed_constants": f"WITH {DIFF} SELECT * FROM cc",
    "dangling_refs": corpus_sql(
        """SELECT repo, range_id, name, path, line, text FROM (SELECT s.*, us.path, us.line, us.text, row_number() OVER (PARTITION BY s.repo, range_id, name ORDER BY us.path, us.line) AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY repo, range_id ORDER BY name) AS nth FROM rs WHERE NOT EXISTS (SELECT 1 FROM code WHERE code.repo = rs.repo AND code.name = rs.name)) s
        JOIN us ON us.repo = s.repo AND name = 'OldWidget' || us.w WHERE nth <= 40) WHERE n <= 5""",
        DIFF, USES,
    ),
    "value_drift": corpus_sql(
        """SELECT repo, range_id, name, old, path, line, text FROM (SELECT s.repo, range_id, name, old, us.path, us.line, us.text, row_number() OVER (PARTITION BY s.repo, range_id, name ORDER BY us.path, us.line) AS n FROM
        cc s JOIN us ON us.repo = s.repo AND name = 'MAX_ITEMS_' || us.w) WHERE n <= 5""",
        DIFF, USES,
    ),
    "added_lines": f"WITH {DIFF} SELECT repo, range_id, path, (10 + k % 90 + i)::INT AS line FROM pd, (VALUES (0), (1), (2)) v(i) WHERE i > 0 OR k % 3 = 0",
    "footgun_added": f"WITH {DIFF} SELECT DISTINCT repo, path, (10 + k % 90 + 2)::INT AS line, '# footgun: new' AS text FROM pd WHERE k % 4 <> 0",
    "footguns": corpus_sql("SELECT repo, path, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS line, '> **Footgun: mind the gap' AS text FROM (SELECT *, content[:strpos(content, '> **Footgun')] AS before FROM d WHERE q % 8 = 1)"),
    "nearest_base": f"WITH {NEAREST} SELECT * FROM nb",
    "push_ranges": f"""WITH {NEAREST}, pu AS (SELECT 'u' || user_id AS repo, 'h' || event_id AS head, CASE WHEN event_id % 5 <> 4 THEN 'b' || event_id END AS base FROM events WHERE event_id % 11 <> 10 AND event_id % 7 <> 6)
        SELECT repo, base, head FROM pu WHERE base IS NOT NULL UNION ALL SELECT pu.repo, nb.base, pu.head FROM pu JOIN nb ON nb.repo = pu.repo AND nb.head = pu.head WHERE pu.base IS NULL""",
    "head_guard": """SELECT repo, event_id, head FROM (SELECT 'u' || user_id AS repo, event_id, 'h-' || event_type AS head, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_type FROM events WHERE event_id % 4 > 0) WHERE before IS NULL OR before <> event_type""",
    "usage_record": f"""SELECT r.repo, (coalesce(f.n, 0) > 0)::INT AS exit, 5::INT AS n_checks, '2026-01-01' AS day, c."check", CASE WHEN c."check" = 'leaks' THEN coalesce(f.n, 0) ELSE 0 END::INT AS n, CASE WHEN c."check" = 'leaks' THEN coalesce(f.m, 0) ELSE 0 END::INT AS n_files FROM (SELECT DISTINCT source AS repo FROM documents) r
        CROSS JOIN (VALUES ('untracked'), ('frontmatter'), ('edges'), ('disconnected'), ('leaks')) c("check")
        LEFT JOIN (SELECT source AS repo, count(*) AS n, count(DISTINCT doc_id || ':' || line) AS m FROM ({leak_sql("documents", "doc_id", "text")}) JOIN documents USING (doc_id) GROUP BY source) f ON f.repo = r.repo""",
    "usage_trend": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, 'u' || (user_id % 10) AS repo, event_type AS \"check\", sum(event_id % 3)::BIGINT AS n FROM events GROUP BY ALL",
}
