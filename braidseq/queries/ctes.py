"""DuckDB SQL for what data.py and the operators derive, as named parts that name what they build on."""

from __future__ import annotations

import re

from ..functions.sequence import LETTER_BASES, LETTERS
from ..functions.sketches import PRIME, slot_factors
from . import data as D

BASES = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{LETTER_BASES}')"
P, W, K, S, T = D.GRAPH, D.GRAPH.window, D.GRAPH.k, D.GRAPH.slots, D.GRAPH.threshold


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTN', 'TGCAN'))"


def sketch(seq: str, k: int, slots: int) -> str:
    """A comma-joined sketch, null for a short sequence."""
    h = f"list_transform(range(1, len({seq}) - {k} + 2), lambda i: ('0x' || substr(md5(least({seq}[i : i + {k - 1}], {rc(f'{seq}[i : i + {k - 1}]')})), 1, 8))::BIGINT)"
    made = ", ".join(f"list_min(list_transform(hs, lambda h: (h * {a} + {b}) % {PRIME}))" for a, b in slot_factors(slots))
    return f"(SELECT CASE WHEN len({seq}) >= {k} THEN [{made}] END FROM (SELECT {h} AS hs))"


def equal(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len({a}) + 1), lambda i: {a}[i] = {b}[i]))"


PARTS = {
    "items": f"SELECT item_id, {BASES} AS seq FROM benchmark",
    "doc_seq": f"SELECT doc_id, {BASES} AS seq FROM documents",
    "doc_reads": f"SELECT doc_id, start, seq[start + 1 : start + {D.TEXT_WINDOW}] AS seq FROM (SELECT doc_id, seq, unnest(list_distinct(list_concat(range(0, len(seq) - {D.TEXT_WINDOW} + 1, {D.TEXT_STRIDE}), [len(seq) - {D.TEXT_WINDOW}]))) AS start FROM doc_seq WHERE len(seq) >= {D.TEXT_WINDOW})",
    "item_windows": f"SELECT item_id, start, seq[start + 1 : start + {D.TEXT_WINDOW}] AS seq FROM (SELECT item_id, seq, unnest(range(0, len(seq) - {D.TEXT_WINDOW} + 1)) AS start FROM items)",
    "msa": """SELECT item_id::INTEGER AS graph_id, a::INTEGER AS row_id, CASE WHEN a = 4 THEN 'consensus' ELSE 'item' || item_id || '-a' || a END AS name,
        CASE WHEN a = 4 THEN seq ELSE array_to_string(list_transform(range(1, len(seq) + 1), lambda p: CASE WHEN a > 0 AND p * a % 37 = 5 THEN '-'
          WHEN a > 0 AND (p + 7 * a) % 29 = 0 THEN translate(seq[p], 'ACGT', 'CGTA') ELSE seq[p] END), '') END AS seq
        FROM items, (SELECT unnest(range(0, 5)) AS a) WHERE len(seq) > 0""",
    "seqs": "SELECT graph_id, row_id AS path_id, name, replace(seq, '-', '') AS seq FROM msa WHERE row_id < 4",
    "cells": "SELECT * FROM (SELECT graph_id, row_id, col, seq[col] AS base FROM (SELECT graph_id, row_id, seq, unnest(range(1, len(seq) + 1)) AS col FROM msa WHERE name <> 'consensus')) WHERE base <> '-'",
    "steps": "SELECT *, lead(col || base) OVER r AS nxt, lag(col || base) OVER r AS prv FROM cells WINDOW r AS (PARTITION BY graph_id, row_id ORDER BY col)",
    "facts": "SELECT graph_id, col, base, string_agg(DISTINCT row_id, ',' ORDER BY row_id) AS rws, count(DISTINCT nxt) AS n_out, count(DISTINCT prv) AS n_in FROM steps GROUP BY ALL",
    "marked": """SELECT c.graph_id, c.row_id, c.col, c.base, CASE WHEN lag(n_out) OVER r = 1 AND n_in = 1 AND lag(rws) OVER r = rws THEN 0 ELSE 1 END AS fresh
        FROM cells c JOIN facts f USING (graph_id, col, base) WINDOW r AS (PARTITION BY c.graph_id, c.row_id ORDER BY c.col)""",
    "chains": "SELECT graph_id, row_id, chain, min(col) AS c0, arg_min(base, col) AS b0, string_agg(base, '' ORDER BY col) AS seq FROM (SELECT *, sum(fresh) OVER (PARTITION BY graph_id, row_id ORDER BY col) AS chain FROM marked) GROUP BY ALL",
    "node_rows": "SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY c0, low)::BIGINT AS node_id FROM (SELECT graph_id, c0, b0, min(row_id) AS low, min(seq) AS seq FROM chains GROUP BY ALL)",
    "nodes": "SELECT graph_id, node_id, seq, len(seq)::INTEGER AS seg_len FROM node_rows",
    "path_nodes": "SELECT c.graph_id, c.row_id AS path_id, (row_number() OVER (PARTITION BY c.graph_id, c.row_id ORDER BY c.c0) - 1)::INTEGER AS ord, n.node_id FROM chains c JOIN node_rows n USING (graph_id, c0, b0)",
    "edges": "SELECT DISTINCT * FROM (SELECT graph_id, node_id AS src, lead(node_id) OVER (PARTITION BY graph_id, path_id ORDER BY ord) AS dst FROM path_nodes) WHERE dst IS NOT NULL",
    "paths": "SELECT graph_id, row_id AS path_id, name FROM msa WHERE name <> 'consensus'",
    "positions": "SELECT p.*, n.seg_len, (sum(seg_len) OVER (PARTITION BY graph_id, path_id ORDER BY ord) - seg_len)::INTEGER AS pos FROM path_nodes p JOIN nodes n USING (graph_id, node_id)",
    "base_map": "SELECT graph_id, path_id, (pos + o)::INTEGER AS pos, node_id, o::INTEGER AS \"offset\" FROM (SELECT *, unnest(range(0, seg_len)) AS o FROM positions)",
    "wins": f"SELECT graph_id, path_id, start::INTEGER AS start, seq[start + 1 : start + {W}] AS seq FROM (SELECT *, unnest(range(0, len(seq) - {W} + 1)) AS start FROM seqs WHERE graph_id NOT IN (SELECT graph_id FROM seqs WHERE len(seq) < {W}))",
    "held": f"SELECT w.graph_id, w.path_id, w.start, b.node_id, count(*)::BIGINT AS n_bases FROM wins w JOIN base_map b ON w.graph_id = b.graph_id AND w.path_id = b.path_id AND b.pos BETWEEN w.start AND w.start + {W - 1} GROUP BY ALL",
    "sketched": f"SELECT graph_id, path_id, start, {sketch('seq', K, S)} AS sketch FROM wins",
    "all_runs": "SELECT graph_id, path_id, run::INTEGER AS run, min(start) AS start, max(start) AS last, (count(*) - 1)::INTEGER AS merge_span, any_value(sketch) AS sketch FROM (SELECT *, sum(fresh) OVER (PARTITION BY graph_id, path_id ORDER BY start) AS run FROM (SELECT *, CASE WHEN lag(sketch) OVER (PARTITION BY graph_id, path_id ORDER BY start) = sketch THEN 0 ELSE 1 END AS fresh FROM sketched)) GROUP BY graph_id, path_id, run",
    "runs": "SELECT * FROM (SELECT *, max(run) OVER (PARTITION BY graph_id, path_id) AS n FROM all_runs) WHERE run < n OR n = 1",
    "begun": "SELECT r.*, b.node_id, b.\"offset\" FROM runs r JOIN base_map b ON r.graph_id = b.graph_id AND r.path_id = b.path_id AND r.start = b.pos",
    "windows": "SELECT *, format('g{}n{}o{}-{}', graph_id, node_id, \"offset\", row_number() OVER (PARTITION BY graph_id, node_id, \"offset\" ORDER BY refs[1], sketch) - 1) AS win_key FROM (SELECT graph_id, node_id, \"offset\", sketch, list_sort(list(DISTINCT path_id)) AS refs, max(merge_span) AS merge_span FROM begun GROUP BY ALL)",
    "contents": "SELECT w.win_key, w.graph_id, h.node_id AS inner_id, sum(h.n_bases)::BIGINT AS n_bases FROM begun b JOIN windows w ON b.graph_id = w.graph_id AND b.node_id = w.node_id AND b.\"offset\" = w.\"offset\" AND b.sketch = w.sketch JOIN held h ON h.graph_id = b.graph_id AND h.path_id = b.path_id AND h.start BETWEEN b.start AND b.last GROUP BY ALL",
    "reads": f"""SELECT format('r_{{}}_{{}}_x_x_x_x_x_x_{{}}$', graph_id, start, name) AS read_id, CASE (start // {D.READ_STRIDE} + path_id) % 6
        WHEN 1 THEN translate(r[1], 'ACGT', 'CGTA') || r[2:] WHEN 2 THEN r[1 : {W - 1}] || translate(r[{W}], 'ACGT', 'CGTA') WHEN 3 THEN {rc('r')}
        WHEN 4 THEN r[1 : {W // 2 - 1}] || translate(r[{W // 2}], 'ACGT', 'CGTA') || r[{W // 2 + 1}:] ELSE r END AS seq, '5' || repeat('I', {W - 1}) AS qual
        FROM (SELECT *, seq[start + 1 : start + {W}] AS r FROM (SELECT *, unnest(range(0, len(seq) - {W} + 1, {D.READ_STRIDE})) AS start FROM seqs))""",
    "read_sketch": f"SELECT read_id, {sketch('seq', K, S)} AS sketch FROM reads",
    "mappings": f"""SELECT r.read_id, w.graph_id, w.win_key, w.node_id, w."offset", w.merge_span, {W} AS window_size, {W - K + 1}::DOUBLE AS n_kmers
        FROM (SELECT *, {equal('a', 'b')} AS e FROM (SELECT DISTINCT r.sketch AS a, w.sketch AS b FROM read_sketch r JOIN windows w ON list_has_any(
          list_transform(range(1, {S + 1}), lambda i: i || ':' || r.sketch[i]), list_transform(range(1, {S + 1}), lambda i: i || ':' || w.sketch[i])))) p
        JOIN read_sketch r ON r.sketch = p.a JOIN windows w ON w.sketch = p.b WHERE 2 * (e / {S}) / (1 + e / {S}) > {T}""",
    "strands": f"SELECT read_id, seq, qual, FALSE AS rc FROM reads UNION ALL SELECT read_id, {rc('seq')}, reverse(qual), TRUE FROM reads",
    "cand": f"""SELECT s.read_id, s.rc, m.graph_id, m.win_key, 1 AS stage, o AS rank, m.node_id, m."offset" + o AS "offset", 0 AS clip_start, 0 AS clip_end
          FROM mappings m JOIN strands s USING (read_id) JOIN nodes n USING (graph_id, node_id), LATERAL (SELECT unnest(range(0, least(m.merge_span + {W} + 1, n.seg_len - m."offset"))) AS o)
        UNION ALL SELECT s.read_id, s.rc, m.graph_id, m.win_key, 2, row_number() OVER (PARTITION BY s.read_id, s.rc, m.win_key ORDER BY c.inner_id, o) - 1, c.inner_id, o, 0, 0
          FROM mappings m JOIN strands s USING (read_id) JOIN contents c USING (win_key) JOIN nodes n ON n.graph_id = m.graph_id AND n.node_id = c.inner_id, LATERAL (SELECT unnest(range(0, least(11, n.seg_len))) AS o)
        UNION ALL SELECT s.read_id, s.rc, m.graph_id, m.win_key, 3, 0, m.node_id, m."offset", 1, 0 FROM mappings m JOIN strands s USING (read_id)
        UNION ALL SELECT s.read_id, s.rc, m.graph_id, m.win_key, 4, 0, m.node_id, m."offset", 0, 1 FROM mappings m JOIN strands s USING (read_id)""",
    "todo": "SELECT DISTINCT graph_id, node_id, \"offset\", s.seq[c.clip_start + 1 : len(s.seq) - c.clip_end] AS seq FROM cand c JOIN strands s ON c.read_id = s.read_id AND c.rc = s.rc",
    "front": """SELECT graph_id, node_id, "offset", seq, node_id AS at, "offset"::BIGINT AS skip, 0::BIGINT AS done, []::BIGINT[] AS trav, FALSE AS ends FROM todo
        UNION ALL SELECT * FROM (SELECT f.graph_id, f.node_id, f."offset", f.seq, CASE WHEN fin THEN NULL ELSE e.dst END, 0::BIGINT, f.done2, f.trav2, fin FROM (
          SELECT f.*, f.done + least(n.seg_len - f.skip, len(f.seq) - f.done) AS done2, list_append(f.trav, f.at) AS trav2,
            f.done + least(n.seg_len - f.skip, len(f.seq) - f.done) = len(f.seq) OR NOT EXISTS (SELECT 1 FROM edges x WHERE x.graph_id = f.graph_id AND x.src = f.at) AS fin
          FROM front f JOIN nodes n ON n.graph_id = f.graph_id AND n.node_id = f.at WHERE NOT f.ends AND f.skip < n.seg_len
            AND f.seq[f.done + 1 : f.done + least(n.seg_len - f.skip, len(f.seq) - f.done)] = n.seq[f.skip + 1 : f.skip + least(n.seg_len - f.skip, len(f.seq) - f.done)]) f
          LEFT JOIN edges e ON NOT fin AND e.graph_id = f.graph_id AND e.src = f.at)""",
    "matches": "SELECT DISTINCT graph_id, node_id, \"offset\", seq, trav FROM front WHERE ends",
    "hits": "SELECT c.*, m.trav FROM cand c JOIN strands s ON c.read_id = s.read_id AND c.rc = s.rc JOIN matches m ON m.graph_id = c.graph_id AND m.node_id = c.node_id AND m.\"offset\" = c.\"offset\" AND m.seq = s.seq[c.clip_start + 1 : len(s.seq) - c.clip_end]",
    "trav_refs": "SELECT t.graph_id, t.\"offset\", t.trav, p.path_id, (min(CASE WHEN p.node_id = t.trav[1] THEN p.pos END) + any_value(t.\"offset\")) AS start FROM (SELECT DISTINCT graph_id, \"offset\", trav FROM hits) t JOIN positions p ON p.graph_id = t.graph_id AND list_contains(t.trav, p.node_id) GROUP BY t.graph_id, t.\"offset\", t.trav, p.path_id HAVING count(*) = len(any_value(t.trav))",
    "refs_of": "SELECT h.read_id, h.graph_id, h.win_key, h.rc, h.stage, h.rank, h.clip_start, h.clip_end, h.trav, r.path_id, r.start FROM hits h JOIN trav_refs r ON r.graph_id = h.graph_id AND r.\"offset\" = h.\"offset\" AND r.trav = h.trav",
    "aligned": """SELECT read_id, graph_id, win_key, rc, stage, rank, clip_start, clip_end, path_id, first_value(start) OVER (PARTITION BY read_id, graph_id, win_key, path_id ORDER BY trav) AS start,
        row_number() OVER (PARTITION BY read_id, graph_id, win_key ORDER BY trav, path_id) - 1 AS nth FROM (
          SELECT *, min((rc::INT * 10 + stage) * 1000000 + rank) OVER (PARTITION BY read_id, graph_id, win_key) AS best FROM refs_of) WHERE (rc::INT * 10 + stage) * 1000000 + rank = best""",
    "tried": """SELECT * FROM (SELECT m.*, coalesce(max(CASE WHEN a.win_key IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY m.read_id, m.graph_id ORDER BY m.node_id, m."offset", m.win_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
        FROM mappings m LEFT JOIN (SELECT DISTINCT read_id, graph_id, win_key FROM aligned) a USING (read_id, graph_id, win_key)) WHERE had = 0""",
    "ref_lens": "SELECT graph_id, path_id, any_value(name) AS ref_name, len(any_value(seq))::INTEGER AS ref_len FROM seqs GROUP BY ALL",
    "records": f"""SELECT a.read_id, a.graph_id, a.path_id, l.ref_name, a.start::INTEGER AS pos,
        CASE WHEN clip_start > 0 THEN clip_start || 'H' ELSE '' END || ({W} - clip_start - clip_end) || 'M' || CASE WHEN clip_end > 0 THEN clip_end || 'H' ELSE '' END AS cigar, 30 AS mapq,
        (CASE WHEN nth > 0 THEN 256 ELSE 0 END + CASE WHEN a.rc THEN 16 ELSE 0 END)::INTEGER AS flags, s.seq[1 : {W} - clip_start - clip_end] AS seq, s.qual[1 : {W} - clip_start - clip_end] AS qual
        FROM aligned a JOIN tried t USING (read_id, graph_id, win_key) JOIN strands s ON s.read_id = a.read_id AND s.rc = a.rc JOIN ref_lens l ON l.graph_id = a.graph_id AND l.path_id = a.path_id""",
    "node_weights": """SELECT graph_id, node_id, sum(CASE WHEN n = 1 THEN n_kmers ELSE seg_len / al * n_kmers * n_bases END) AS kmer_freq FROM (
        SELECT t.graph_id, c.inner_id AS node_id, t.n_kmers, c.n_bases, n.seg_len, sum(n.seg_len) OVER r AS al, count(*) OVER r AS n
        FROM tried t JOIN contents c USING (win_key) JOIN nodes n ON n.graph_id = t.graph_id AND n.node_id = c.inner_id WINDOW r AS (PARTITION BY t.read_id, t.graph_id, t.win_key)) GROUP BY ALL""",
    "cover": "SELECT n.graph_id, n.node_id, coalesce(w.kmer_freq, 0) / n.seg_len AS count FROM nodes n LEFT JOIN node_weights w ON w.graph_id = n.graph_id AND w.node_id = n.node_id",
    "bare_nodes": f"SELECT DISTINCT graph_id, node_id FROM cover JOIN path_nodes USING (graph_id, node_id) WHERE count < {P.min_coverage}",
    "bare_paths": "SELECT DISTINCT graph_id, path_id FROM path_nodes JOIN bare_nodes USING (graph_id, node_id)",
    "alive": "SELECT e.graph_id, e.path_id, b.path_id IS NULL AS live FROM (SELECT DISTINCT graph_id, path_id FROM path_nodes) e LEFT JOIN bare_paths b USING (graph_id, path_id)",
    "listed": "SELECT graph_id, path_id FROM alive WHERE graph_id IN (SELECT graph_id FROM alive WHERE live)",
    "read_ec": "SELECT p.graph_id, p.node_id, p.path_id, c.count FROM path_nodes p JOIN (SELECT graph_id, path_id FROM alive WHERE live) USING (graph_id, path_id) JOIN cover c USING (graph_id, node_id)",
    "read_alpha0": "SELECT graph_id, path_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph_id) AS alpha FROM listed",
    "kmer_totals": "SELECT graph_id, sum(n_kmers) AS kmer_total FROM (SELECT t.read_id, t.graph_id, t.win_key, any_value(t.n_kmers) AS n_kmers FROM tried t JOIN contents c USING (win_key) JOIN nodes n ON n.graph_id = t.graph_id AND n.node_id = c.inner_id GROUP BY t.read_id, t.graph_id, t.win_key HAVING count(*) > 1) GROUP BY graph_id",
    "made": "SELECT graph_id, node_id, ((node_id * 37 + graph_id * 11) % 211) * seg_len / 10.0::DOUBLE AS kmer_freq, seg_len FROM nodes",
    "low_nodes": "SELECT graph_id, node_id FROM made WHERE kmer_freq / seg_len < 0.15",
    "bad_paths": "SELECT DISTINCT graph_id, path_id FROM path_nodes JOIN low_nodes USING (graph_id, node_id)",
    "path_state": "SELECT p.graph_id, p.path_id, b.path_id IS NULL AS live FROM paths p LEFT JOIN bad_paths b USING (graph_id, path_id)",
    "kept_graphs": "SELECT graph_id FROM path_state GROUP BY graph_id HAVING bool_or(live)",
    "live_nodes": "SELECT n.* FROM nodes n SEMI JOIN kept_graphs USING (graph_id) ANTI JOIN low_nodes USING (graph_id, node_id)",
    "line_al": "SELECT CASE WHEN l_partkey % 5 = 0 THEN '*' ELSE '' END || 'part' || l_partkey AS ref_name, (l_orderkey * 7 % (200 + l_partkey % 300))::INTEGER AS pos, (30 + l_linenumber * 10)::INTEGER AS span, CASE l_linenumber WHEN 7 THEN 4 WHEN 6 THEN 256 ELSE 0 END AS flags FROM lineitem",
    "line_ref": "SELECT CASE WHEN p_partkey % 5 = 0 THEN '*' ELSE '' END || 'part' || p_partkey AS ref_name, (200 + p_partkey % 300)::INTEGER AS ref_len FROM part",
    "line_iv": "SELECT a.ref_name, r.ref_len, a.pos, least(a.pos + a.span, r.ref_len - 1) AS hi FROM line_al a JOIN line_ref r USING (ref_name) WHERE flags <> 4",
    "line_hit": "SELECT ref_name, p, count(*) AS n FROM (SELECT ref_name, unnest(range(pos, hi + 1)) AS p FROM line_iv) GROUP BY ALL",
    "depths": "SELECT b.ref_name, b.p::INTEGER AS pos, coalesce(h.n, 0)::BIGINT AS depth FROM (SELECT ref_name, unnest(range(0, ref_len)) AS p FROM (SELECT DISTINCT ref_name, ref_len FROM line_iv)) b LEFT JOIN line_hit h USING (ref_name, p)",
    "line_runs": "SELECT ref_name, run, op, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY ref_name ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY ref_name ORDER BY pos) = op THEN 0 ELSE 1 END AS fresh FROM (SELECT ref_name, pos, CASE WHEN depth > 0 THEN 'M' ELSE 'D' END AS op FROM depths))) GROUP BY ALL",
    "cigars": """SELECT ref_name, CASE WHEN sum(n) = 1 THEN '' ELSE string_agg(n || op, '' ORDER BY run) END AS cigar,
        sum(n) > 1 AND NOT (count(*) FILTER (counts) <= 2 OR (count(*) FILTER (counts AND op = 'D') = 2 AND count(*) FILTER (counts AND op = 'M') = 1)) AS internal_gap
        FROM (SELECT *, NOT (row_number() OVER (PARTITION BY ref_name ORDER BY run DESC) = 2 AND coalesce(lead(n) OVER (PARTITION BY ref_name ORDER BY run), 0) = 1) AS counts FROM line_runs) GROUP BY ref_name""",
    "wide": "SELECT ref_name, count(*) FILTER (depth > 0)::BIGINT AS covered, count(*)::BIGINT AS ref_len, covered / count(*) AS share FROM depths GROUP BY ref_name",
    "line_n": "SELECT ref_name, count(*)::BIGINT AS read_count FROM line_al WHERE flags <> 4 GROUP BY ref_name",
    "line_rows": "SELECT DISTINCT (l_orderkey % 50)::INTEGER AS graph_id, l_orderkey AS node_id, (l_suppkey % 7)::INTEGER AS path_id FROM lineitem",
    "line_counts": "SELECT (l_orderkey % 50)::INTEGER AS graph_id, l_orderkey AS node_id, sum(l_quantity) / 10 AS count FROM lineitem GROUP BY ALL",
    "ec": "SELECT r.*, c.count FROM line_rows r JOIN line_counts c USING (graph_id, node_id)",
    "alpha0": "SELECT graph_id, path_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph_id) AS alpha FROM (SELECT DISTINCT graph_id, path_id FROM line_rows)",
}
for _i in (1, 2, 3):
    PARTS[f"alpha{_i}"] = f"SELECT a.graph_id, a.path_id, coalesce(n.s, 0)::DOUBLE AS alpha FROM alpha{_i - 1} a LEFT JOIN (SELECT graph_id, path_id, sum(alpha * count / al) AS s FROM (SELECT e.*, a.alpha, sum(a.alpha) OVER (PARTITION BY e.graph_id, e.node_id) AS al FROM ec e JOIN alpha{_i - 1} a USING (graph_id, path_id) WHERE e.count > 0) WHERE al >= 2.0 ** -52 GROUP BY ALL) n USING (graph_id, path_id)"

BIG = {"sketched", "read_sketch", "mappings", "cand", "todo", "hits", "aligned", "windows", "contents", "positions", "nodes", "path_nodes", "edges", "refs_of", "matches", "node_weights", "cover", "alive", "read_ec", "read_alpha0"}


def sql(body: str) -> str:
    """body with the parts it names, and those they name, in front."""
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in PARTS:
            if name != own and name not in order and re.search(rf"(?<![\w'.]){name}(?![\w'])", text):
                visit(PARTS[name], name)
                order.append(name)

    visit(body)
    parts = ", ".join(f"{name} AS {'MATERIALIZED ' if name in BIG else ''}({PARTS[name]})" for name in order)
    return f"WITH {'RECURSIVE ' if 'front' in order else ''}{parts} {body}" if order else body
