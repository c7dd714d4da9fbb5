"""One query per operator, over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..functions import sketches as S
from ..operators import align as A
from ..operators import em as E
from ..operators import graph as G
from ..operators import report as R
from ..operators import windows as W
from ..operators.containment import band_index, containment_join, min_match
from ..plans import pipelines as P
from ..sources import formats as IO
from ..sources.staging import staged
from . import data as D
from .ctes import K as GK
from .ctes import S as GS
from .ctes import W as GW
from .ctes import equal, rc, sketch, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return add


def joined(c) -> Column:
    """An array as a comma-joined string."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def long(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


SP = lambda c: f"array_to_string({c}, ',')"
ITEM_K = 7


# --- sources -------------------------------------------------------------------------------------
def lines_of(spark, sf_dir):
    """conversation turns as the lines of a file per conversation."""
    return D.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), F.col("text").alias("line"))


@query("""SELECT lang AS file, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS line_no, len(line)::BIGINT AS n, md5(line) AS hash FROM (
  SELECT lang, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT lang, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))""")
def scan_lines(spark, sf_dir):
    """Files of all texts of a language, written and read again in splits."""
    lines = IO.scan_lines(spark, D.text_files(spark, sf_dir))
    return lines.select(F.regexp_extract("file", "lang=([^/]*)", 1).alias("file"), long("line_no", "line_no"), long(F.length("line"), "n"), F.md5("line").alias("hash"))


@query("SELECT conv_id::VARCHAR AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, text AS line FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[\n]', ' ', 'g')) AS text FROM conversations) WHERE text <> ''")
def chunk_lines(spark, sf_dir):
    """The turns of a conversation as lines of a file that comes in pieces cut in the middle of each line."""
    turns = lines_of(spark, sf_dir).withColumn("line", F.concat(F.regexp_replace("line", "[\n]", " "), F.lit("\n")))
    half = F.floor(F.length("line") / 2).cast("int")
    cut = F.array(F.substring(F.col("line"), F.lit(1), half), F.substring(F.col("line"), half + 1, F.length("line")))
    pieces = turns.select("file", F.col("line_no").alias("turn"), F.posexplode(cut).alias("i", "chunk"))
    found = IO.chunk_lines(pieces.select("file", (F.col("turn") * 2 + F.col("i")).cast("long").alias("nth"), "chunk"))
    nth = F.row_number().over(R.Window.partitionBy("file").orderBy("line_no")) - 1
    return found.select("file", long(nth, "line_no"), "line")


def fastq_lines(spark, sf_dir):
    reads = D.simulated_reads(spark, sf_dir).withColumn("file", F.split("read_id", "_")[1])
    nth = F.row_number().over(R.Window.partitionBy("file").orderBy("read_id")) - 1
    parts = F.array(F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "qual")
    return reads.withColumn("nth", nth).select("file", F.posexplode(parts).alias("i", "line"), "nth").select("file", (F.col("nth") * 4 + F.col("i")).cast("long").alias("line_no"), "line")


@query("SELECT split_part(read_id, '_', 2) AS file, row_number() OVER (PARTITION BY split_part(read_id, '_', 2) ORDER BY read_id) - 1 AS nth, '@' || read_id AS read_id, seq, '+' AS misc, qual FROM reads")
def parse_fastq(spark, sf_dir):
    return IO.parse_fastq(fastq_lines(spark, sf_dir))


def fasta_lines(spark, sf_dir):
    """Each graph's rows as FASTA in lines of 60."""
    rows = D.msa(spark, sf_dir).withColumn("file", F.lpad(F.col("graph_id").cast("string"), 8, "0"))
    body = Q.once(F.col("seq"), lambda s: F.transform(Q.counted(F.ceil(F.length(s) / 60)), lambda i: F.substring(s, (i * 60 + 1).cast("int"), F.lit(60))))
    return rows.select("file", "row_id", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "name")), body)).alias("i", "line")).select("file", (F.col("row_id") * 10000 + F.col("i")).cast("long").alias("line_no"), "line")


@query("SELECT lpad(graph_id::VARCHAR, 8, '0') AS file, row_id::BIGINT AS nth, '@' || name AS read_id, seq FROM msa")
def parse_fasta(spark, sf_dir):
    return IO.parse_fasta(fasta_lines(spark, sf_dir))


@query("SELECT (dense_rank() OVER (ORDER BY graph_id) - 1)::INTEGER AS graph_id, row_id, name, seq FROM msa")
def parse_msa(spark, sf_dir):
    return IO.parse_msa(fasta_lines(spark, sf_dir))


@query("SELECT conv_id, turn, starts_with(text, 'T') AS ok FROM conversations")
def validate_reads(spark, sf_dir):
    """Turns whose first letter is T stand for reads with a proper id."""
    rows = D.table(spark, sf_dir, "conversations").withColumn("read_id", F.concat(F.when(F.col("text").startswith("T"), "@").otherwise("x"), "text"))
    return IO.validate_reads(rows, False).select("conv_id", "turn", "ok")


def gfa_file(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    lines = IO.gfa_lines(g, D.made_weights(g), ["weighted by k-mers (total over all graphs: 12345)"])
    order = F.row_number().over(R.Window.partitionBy("graph_id").orderBy("section", "k1", "k2")) - 1
    return lines.select(F.lpad(F.col("graph_id").cast("string"), 8, "0").alias("file"), order.cast("long").alias("line_no"), "line")


@query("""SELECT graph_id, 0 AS section, 0::BIGINT AS k1, 0::BIGINT AS k2, 'H' || chr(9) || 'VN:Z:1' AS line FROM heavy
UNION ALL SELECT graph_id, 2, node_id, 0, concat_ws(chr(9), 'S', node_id, seq, 'LN:i:' || seg_len, 'KC:i:' || floor(kmer_freq)::BIGINT) FROM (SELECT n.*, m.kmer_freq FROM nodes n JOIN made m USING (graph_id, node_id)) JOIN heavy USING (graph_id)
UNION ALL SELECT graph_id, 3, src, dst, concat_ws(chr(9), 'L', src, '+', dst, '+', '0M') FROM edges JOIN heavy USING (graph_id)
UNION ALL SELECT graph_id, 4, path_id, 0, concat_ws(chr(9), 'P', any_value(name), string_agg(node_id || '+', ',' ORDER BY ord), string_agg(seg_len || 'M', ',' ORDER BY ord)) FROM positions JOIN paths USING (graph_id, path_id) JOIN heavy USING (graph_id) GROUP BY graph_id, path_id""".replace("heavy", "(SELECT graph_id FROM made GROUP BY graph_id HAVING max(kmer_freq) > 0)"))
def write_gfa(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return IO.gfa_lines(g, D.made_weights(g))


@query("""SELECT * FROM (WITH heavy AS (SELECT graph_id, (dense_rank() OVER (ORDER BY graph_id) - 1) AS g FROM (SELECT graph_id FROM made GROUP BY graph_id HAVING max(kmer_freq) > 0))
SELECT 'node' AS kind, g, n.node_id AS a, floor(m.kmer_freq)::BIGINT AS b, n.seq AS text FROM nodes n JOIN made m USING (graph_id, node_id) JOIN heavy USING (graph_id)
UNION ALL SELECT 'edge', g, src, dst, '' FROM edges JOIN heavy USING (graph_id)
UNION ALL SELECT 'step', g, ord, node_id, name FROM path_nodes JOIN paths USING (graph_id, path_id) JOIN heavy USING (graph_id))""")
def parse_gfa(spark, sf_dir):
    """Every segment, link and step of a path that was written and read."""
    g, weights = IO.parse_gfa(staged(gfa_file(spark, sf_dir), "gfa-lines"))
    row = lambda df, kind, a, b, text: df.select(F.lit(kind).alias("kind"), long("graph_id", "g"), long(a, "a"), long(b, "b"), text.alias("text"))
    out = row(g.nodes.join(weights, ["graph_id", "node_id"]), "node", "node_id", "kmer_freq", F.col("seq"))
    return out.unionByName(row(g.edges, "edge", "src", "dst", F.lit(""))).unionByName(row(g.path_nodes.join(g.paths, ["graph_id", "path_id"]), "step", "ord", "node_id", F.col("name")))


@query("SELECT lpad(graph_id::VARCHAR, 8, '0') AS file, 12345::BIGINT AS total FROM (SELECT graph_id FROM made GROUP BY graph_id HAVING max(kmer_freq) > 0)")
def gfa_total_kmers(spark, sf_dir):
    lines = gfa_file(spark, sf_dir).withColumn("line", F.replace("line", F.lit("over all graphs: "), F.lit("in graphs: ")))
    return IO.gfa_total_kmers(lines)


@query("SELECT graph_id, path_id, '>' || name || chr(10) || seq AS line FROM seqs")
def alleles_fasta(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return IO.fasta_lines(g.paths, G.graph_to_sequences(g.path_nodes, g.nodes))


# --- functions -----------------------------------------------------------------------------------
@query("SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^ -~]', '-', 'g')), '[^ACGTN]', 'N', 'g') AS seq FROM documents")
def base_check(spark, sf_dir):
    """Whole texts; what is not printable ASCII becomes a dash first, as engines differ in its upper case."""
    return D.table(spark, sf_dir, "documents").select("doc_id", Q.base_check(F.regexp_replace("text", "[^ -~]", "-")).alias("seq"))


@query(f"SELECT doc_id, start, {rc('seq')} AS seq FROM doc_reads")
def revcomp(spark, sf_dir):
    return D.document_reads(spark, sf_dir).select("doc_id", long("start", "start"), Q.revcomp(F.col("seq")).alias("seq"))


@query(f"SELECT item_id, i::BIGINT AS i, seq[i + 1 : i + {ITEM_K}] AS kmer FROM (SELECT *, unnest(range(0, len(seq) - {ITEM_K} + 1)) AS i FROM items)")
def kmers(spark, sf_dir):
    return D.items(spark, sf_dir).select("item_id", F.posexplode(Q.kmers(F.col("seq"), ITEM_K)).alias("i", "kmer")).select("item_id", long("i", "i"), "kmer")


@query(f"SELECT kmer, count(*) AS n FROM (SELECT least(k, {rc('k')}) AS kmer FROM (SELECT seq[i + 1 : i + {ITEM_K}] AS k FROM (SELECT *, unnest(range(0, len(seq) - {ITEM_K} + 1)) AS i FROM doc_seq))) GROUP BY kmer")
def canonical_kmers(spark, sf_dir):
    seen = D.document_sequences(spark, sf_dir).select(F.explode(Q.kmers(F.col("seq"), ITEM_K)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return seen.groupBy(Q.canonical(F.col("k")).alias("kmer")).agg(F.sum("n").alias("n"))


KMER_ROWS = f"(SELECT item_id, ('0x' || substr(md5(least(k, {rc('k')})), 1, 8))::BIGINT AS h FROM (SELECT item_id, seq[i + 1 : i + {ITEM_K}] AS k FROM (SELECT *, unnest(range(0, len(seq) - {ITEM_K} + 1)) AS i FROM items)))"


@query(f"SELECT item_id, h FROM {KMER_ROWS}")
def kmer_hash(spark, sf_dir):
    return D.items(spark, sf_dir).select("item_id", F.explode(S.kmer_hashes(F.col("seq"), ITEM_K)).alias("h"))


@query(f"SELECT item_id, start::BIGINT AS start, {SP(sketch('seq', D.TEXT_K, D.TEXT_SLOTS))} AS sketch FROM item_windows")
def khf_sketch(spark, sf_dir):
    return D.item_windows(spark, sf_dir).select("item_id", long("start", "start"), joined(S.khf_sketch(F.col("seq"), D.TEXT_K, D.TEXT_SLOTS)).alias("sketch"))


KMV = f"(SELECT item_id, list_resize(list(h ORDER BY h DESC), 16, 0) AS sk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h) AS r FROM {KMER_ROWS}) WHERE r <= 16 GROUP BY item_id)"


@query(f"SELECT item_id, {SP('sk')} AS sketch FROM {KMV}")
def kmv_sketch(spark, sf_dir):
    return D.items(spark, sf_dir).where(F.length("seq") >= ITEM_K).select("item_id", joined(S.kmv_sketch(F.col("seq"), ITEM_K, 16)).alias("sketch"))


def neighbours(df, key: str, *columns: str):
    """Each row beside the one with the next key."""
    nxt = df.select((F.col(key) - 1).alias(key), *(F.col(c).alias(f"{c}2") for c in columns))
    return df.join(nxt, key)


@query(f"SELECT a.item_id, {equal('a.sk', 'b.sk')} / 21 AS j FROM (SELECT item_id, {sketch('seq', 5, 21)} AS sk FROM items) a JOIN (SELECT item_id, {sketch('seq', 5, 21)} AS sk FROM items) b ON b.item_id = a.item_id + 1")
def khf_jaccard(spark, sf_dir):
    rows = D.items(spark, sf_dir).select("item_id", S.khf_sketch(F.col("seq"), 5, 21).alias("s"))
    return neighbours(rows, "item_id", "s").select("item_id", S.khf_jaccard(F.col("s"), F.col("s2")).alias("j"))


@query(f"""SELECT a.item_id, coalesce(sum(CASE WHEN b.n IS NULL THEN 0 ELSE least(a.n, b.n) END), 0) / 16 AS j FROM (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(sk) AS x FROM {KMV}) GROUP BY ALL) a
LEFT JOIN (SELECT item_id, x, count(*) AS n FROM (SELECT item_id, unnest(sk) AS x FROM {KMV}) GROUP BY ALL) b ON b.item_id = a.item_id + 1 AND b.x = a.x WHERE a.item_id + 1 IN (SELECT item_id FROM {KMV}) GROUP BY a.item_id""")
def kmv_jaccard(spark, sf_dir):
    rows = D.items(spark, sf_dir).where(F.length("seq") >= ITEM_K).select("item_id", S.kmv_sketch(F.col("seq"), ITEM_K, 16).alias("s"))
    return neighbours(rows, "item_id", "s").select("item_id", S.kmv_jaccard(F.col("s"), F.col("s2")).alias("j"))


@query(f"""SELECT a.item_id, count(b.h) / count(*) AS j FROM (SELECT DISTINCT * FROM {KMER_ROWS}) a LEFT JOIN (SELECT DISTINCT * FROM {KMER_ROWS}) b ON b.item_id = a.item_id + 1 AND a.h = b.h
WHERE a.item_id + 1 IN (SELECT item_id FROM {KMER_ROWS}) GROUP BY a.item_id""")
def exact_jaccard(spark, sf_dir):
    rows = D.items(spark, sf_dir).where(F.length("seq") >= ITEM_K).select("item_id", S.kmer_hashes(F.col("seq"), ITEM_K).alias("h"))
    return neighbours(rows, "item_id", "h").select("item_id", S.exact_jaccard(F.col("h"), F.col("h2")).alias("j"))


@query("SELECT doc_id, h, h % 9984 IN (SELECT ('0x' || substr(md5(upper(seq)), 1, 8))::BIGINT % 9984 FROM items) AS maybe FROM (SELECT doc_id, ('0x' || substr(md5(seq), 1, 8))::BIGINT AS h FROM doc_seq)")
def bloom_membership(spark, sf_dir):
    asked = D.table(spark, sf_dir, "documents").select("doc_id", S.kmer_hash(Q.text_to_bases(F.col("text"))).alias("h"))
    return S.bloom_membership(D.items(spark, sf_dir).select(S.kmer_hash(F.col("seq")).alias("h")), asked).select("doc_id", "h", "maybe")


def _cut_sql(order: str) -> str:
    """How many bases go from one end: up to the first greatest running sum above 0 before the first below 0."""
    run = f"SELECT read_id, n, row_number() OVER w AS k, sum(30 - q) OVER w AS s FROM base_q WINDOW w AS (PARTITION BY read_id ORDER BY {order})"
    open_ = f"SELECT *, coalesce(min(CASE WHEN s < 0 THEN k END) OVER (PARTITION BY read_id), n + 1) AS bad FROM ({run})"
    return f"SELECT read_id, any_value(n) AS n, coalesce(arg_max(k, s * 1000 - k) FILTER (s > 0 AND k < bad), 0) AS cut FROM ({open_}) GROUP BY read_id"


@query(f"""SELECT * FROM (WITH base_q AS (SELECT read_id, n, i, ord(quals[i]) - 33 AS q FROM (SELECT read_id, len(seq) AS n, substr(translate(md5(read_id) || md5(read_id || 'x'), '0123456789abcdef', '{D.QUALITIES}'), 1, len(seq)) AS quals, unnest(range(1, len(seq) + 1)) AS i FROM reads))
SELECT a.read_id, CASE WHEN a.cut >= a.n - b.cut THEN 0 ELSE a.cut END::BIGINT AS s, CASE WHEN a.cut >= a.n - b.cut THEN 0 ELSE a.n - b.cut END::BIGINT AS e FROM ({_cut_sql('i')}) a JOIN ({_cut_sql('i DESC')}) b USING (read_id))""")
def qual_trim(spark, sf_dir):
    rows = D.simulated_reads(spark, sf_dir).withColumn("b", Q.qual_trim_bounds(D.qualities(F.col("read_id"), F.length("seq")), 30))
    return rows.select("read_id", long("b.start", "s"), long("b.end", "e"))


@query("SELECT read_id, split_part(read_id, '_', 3)::INTEGER AS start, regexp_extract(split_part(read_id, '_', 10), '^[^$ ]*') AS ref FROM reads")
def parse_read_name(spark, sf_dir):
    return D.simulated_reads(spark, sf_dir).withColumn("t", Q.read_name_truth(F.col("read_id"))).select("read_id", "t.start", "t.ref")


# --- graphs --------------------------------------------------------------------------------------
@query("SELECT graph_id, path_id, string_agg(node_id || ':' || seq, ',' ORDER BY ord) AS walk FROM path_nodes JOIN nodes USING (graph_id, node_id) GROUP BY ALL")
def msa_to_graph(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    rows = g.path_nodes.join(g.nodes, ["graph_id", "node_id"]).groupBy("graph_id", "path_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_id", "seq"))).alias("x"))
    return rows.select("graph_id", "path_id", F.array_join(F.transform("x", lambda x: F.concat(x["node_id"].cast("string"), F.lit(":"), x["seq"])), ",").alias("walk"))


@query("SELECT graph_id, node_id, seq, seg_len FROM nodes")
def graph_nodes(spark, sf_dir):
    return D.graph(spark, sf_dir).nodes


@query("SELECT graph_id, src, dst FROM edges")
def graph_edges(spark, sf_dir):
    return D.graph(spark, sf_dir).edges


@query("SELECT graph_id, path_id, ord, node_id FROM path_nodes")
def graph_paths(spark, sf_dir):
    return D.graph(spark, sf_dir).path_nodes


@query("SELECT graph_id, node_id, (row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1)::INTEGER AS topo_ord FROM nodes")
def topo_order(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return G.topo_order(g.nodes, g.edges)


@query("SELECT graph_id, path_id, ord, node_id, seg_len, pos FROM positions")
def path_positions(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return G.path_positions(g.path_nodes, g.nodes)


@query("SELECT graph_id, path_id, seq FROM seqs")
def graph2seqs(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return G.graph_to_sequences(g.path_nodes, g.nodes)


@query("SELECT graph_id, path_id, len(seq)::INTEGER AS length FROM seqs")
def path_lengths(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return G.path_lengths(g.path_nodes, g.nodes)


@query("SELECT graph_id, min(len(seq)) < 150 AS masked FROM seqs GROUP BY graph_id")
def mask_graphs(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return G.mask_graphs(G.path_lengths(g.path_nodes, g.nodes), 150)


@query("SELECT graph_id, path_id, ref_name, ref_len FROM ref_lens")
def sam_refs(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return G.sam_references(g.paths, G.path_lengths(g.path_nodes, g.nodes))


@query("SELECT graph_id, path_id, name FROM paths WHERE (graph_id, path_id) NOT IN (SELECT (graph_id, path_id) FROM bad_paths)")
def remove_dead_paths(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    kept, _ = G.prune(g, D.made_weights(g), D.LOW)
    return G.remove_dead_paths(g.paths, kept.path_nodes)


@query("""SELECT 'node' AS kind, graph_id, node_id AS a, 0::BIGINT AS b FROM live_nodes
UNION ALL SELECT 'edge', e.graph_id, e.src, e.dst FROM edges e JOIN live_nodes a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN live_nodes b ON b.graph_id = e.graph_id AND b.node_id = e.dst
UNION ALL SELECT 'step', p.graph_id, p.path_id, p.node_id FROM path_nodes p SEMI JOIN kept_graphs USING (graph_id) ANTI JOIN bad_paths USING (graph_id, path_id)""")
def prune(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    kept, _ = G.prune(g, D.made_weights(g), D.LOW)
    row = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), "graph_id", long(a, "a"), long(b, "b"))
    return row(kept.nodes, "node", "node_id", F.lit(0)).unionByName(row(kept.edges, "edge", "src", "dst")).unionByName(row(kept.path_nodes, "step", "path_id", "node_id"))


@query("SELECT graph_id, count(*) AS n_paths, count(*) FILTER (live) AS n_live FROM path_state SEMI JOIN kept_graphs USING (graph_id) GROUP BY graph_id")
def prune_summary(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    _, listed = G.prune(g, D.made_weights(g), D.LOW)
    return listed.groupBy("graph_id").agg(F.count("*").alias("n_paths"), F.count_if("live").alias("n_live"))


# --- windows and index ---------------------------------------------------------------------------
def windowed(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    positions = G.path_positions(g.path_nodes, g.nodes)
    masked = G.mask_graphs(G.path_lengths(g.path_nodes, g.nodes), GW).where("masked")
    windows = W.path_windows(G.graph_to_sequences(g.path_nodes, g.nodes).join(masked, "graph_id", "left_anti"), GW)
    return g, positions, windows


@query("SELECT graph_id, path_id, pos, node_id, \"offset\" FROM base_map")
def path_base_map(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return W.path_base_map(G.path_positions(g.path_nodes, g.nodes))


@query("SELECT graph_id, path_id, start, seq FROM wins")
def path_windows(spark, sf_dir):
    return windowed(spark, sf_dir)[2]


@query("SELECT graph_id, path_id, start, node_id, n_bases FROM held")
def window_nodes(spark, sf_dir):
    _, positions, windows = windowed(spark, sf_dir)
    return W.window_nodes(windows, positions, GW)


@query(f"SELECT graph_id, path_id, run, start, last, merge_span, {SP('sketch')} AS sketch FROM runs")
def merge_runs(spark, sf_dir):
    return W.merge_runs(W.sketch_windows(windowed(spark, sf_dir)[2], GK, GS)).withColumn("sketch", joined("sketch"))


@query(f"SELECT graph_id, node_id, \"offset\", {SP('sketch')} AS sketch, {SP('refs')} AS refs, merge_span FROM windows")
def merge_paths(spark, sf_dir):
    return D.index(spark, sf_dir).windows.select("graph_id", "node_id", "offset", joined("sketch").alias("sketch"), joined("refs").alias("refs"), "merge_span")


@query("SELECT win_key, graph_id, node_id, \"offset\" FROM windows")
def window_keys(spark, sf_dir):
    return D.index(spark, sf_dir).windows.select("win_key", "graph_id", "node_id", "offset")


@query("SELECT win_key, graph_id, inner_id, n_bases FROM contents")
def window_contents(spark, sf_dir):
    return D.index(spark, sf_dir).contents


@query("SELECT s.graph_id, count(*) AS n_windows, count(DISTINCT sketch) AS n_distinct, any_value(m) AS max_span FROM sketched s JOIN (SELECT graph_id, max(merge_span) AS m FROM all_runs GROUP BY graph_id) USING (graph_id) GROUP BY s.graph_id")
def sketch_stats(spark, sf_dir):
    return W.check_span(W.sketch_stats(W.sketch_windows(windowed(spark, sf_dir)[2], GK, GS)), 10_000)


@query(f"SELECT band::BIGINT AS band, count(*) AS n_windows, count(DISTINCT sk) AS n_hashes FROM (SELECT b AS band, sketch[(b * {GS} // 3) + 1 : ((b + 1) * {GS} // 3)] AS sk FROM windows, (SELECT unnest(range(0, 3)) AS b)) GROUP BY band")
def window_bands(spark, sf_dir):
    rows = band_index(D.index(spark, sf_dir).windows, 3, GS)
    return rows.groupBy(long("band", "band")).agg(F.count("*").alias("n_windows"), F.countDistinct("band_hash").alias("n_hashes"))


# --- joins ---------------------------------------------------------------------------------------
TEXT_HITS = f"(SELECT r.doc_id, r.start, w.item_id FROM (SELECT doc_id, start, {sketch('seq', D.TEXT_K, D.TEXT_SLOTS)} AS sk FROM doc_reads) r JOIN (SELECT DISTINCT item_id, {sketch('seq', D.TEXT_K, D.TEXT_SLOTS)} AS sk FROM item_windows) w ON r.sk = w.sk)"


_text_hits: dict[tuple[str, str], DataFrame] = {}


def text_hits(spark, sf_dir) -> DataFrame:
    """Chunks of documents that contain a window of a benchmark item: (read_key (doc_id, start), win_key). Found once
    per application and folder, and kept as a table, for the queries that share them."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _text_hits:
        _text_hits[key] = staged(_find_text_hits(spark, sf_dir), "text-hits")
    return _text_hits[key]


def _find_text_hits(spark, sf_dir) -> DataFrame:
    reads = D.document_reads(spark, sf_dir).select(F.struct("doc_id", "start").alias("read_key"), S.khf_sketch(F.col("seq"), D.TEXT_K, D.TEXT_SLOTS).alias("sketch"), F.lit(D.TEXT_WINDOW - D.TEXT_K + 1).alias("q"))
    windows = D.item_windows(spark, sf_dir).select(F.col("item_id").alias("win_key"), S.khf_sketch(F.col("seq"), D.TEXT_K, D.TEXT_SLOTS).alias("sketch")).distinct()
    n = D.TEXT_WINDOW - D.TEXT_K + 1
    return containment_join(reads, windows, D.TEXT_SLOTS, n, D.TEXT_T, [n])


@query(f"SELECT DISTINCT item_id, doc_id, start::BIGINT AS start FROM {TEXT_HITS}")
def containment_join_text(spark, sf_dir):
    return text_hits(spark, sf_dir).select(F.col("win_key").alias("item_id"), "read_key.doc_id", long("read_key.start", "start")).distinct()


@query("SELECT read_id, graph_id, win_key FROM mappings")
def containment_join_graph(spark, sf_dir):
    return P.map_reads(D.simulated_reads(spark, sf_dir), D.index(spark, sf_dir)).select("read_id", "graph_id", "win_key")


@query("""SELECT l_linenumber::BIGINT AS line, q, x, t, min(m)::BIGINT AS need FROM (SELECT DISTINCT l_linenumber, 30 + 10 * l_linenumber::BIGINT AS q, 70::BIGINT AS x, CASE WHEN l_linenumber % 2 = 0 THEN 0.99 ELSE 0.9 END::DOUBLE AS t FROM lineitem)
LEFT JOIN (SELECT unnest(range(1, 22)) AS m) ON (x::DOUBLE / q + 1) * (m / 21) / (1 + m / 21) > t GROUP BY ALL""")
def min_matches(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select(long("l_linenumber", "line"), (30 + 10 * F.col("l_linenumber").cast("long")).alias("q"), F.lit(70).cast("long").alias("x"))
    need = lambda t: min_match(F.col("q"), 70, 21, t).cast("long")
    even = F.col("line") % 2 == 0
    return rows.withColumn("t", F.when(even, 0.99).otherwise(0.9)).withColumn("need", F.when(even, need(0.99)).otherwise(need(0.9)))


@query("SELECT a.read_id, a.path_id, l.ref_name, l.ref_len FROM aligned a JOIN ref_lens l USING (graph_id, path_id)")
def ref_join(spark, sf_dir):
    g, reads, index, mappings, aligned, refs = aligned_parts(spark, sf_dir)
    return R.reference_join(aligned, refs).select("read_id", "path_id", "ref_name", "ref_len")


# --- mapping and alignment -----------------------------------------------------------------------
@query("SELECT count(*) AS n_reads, avg(len(seq)) AS mean_length FROM doc_seq")
def read_stats(spark, sf_dir):
    return A.read_stats(D.table(spark, sf_dir, "documents").select(Q.text_to_bases(F.col("text")).alias("seq")))


@query(f"""SELECT (SELECT count(*) FROM documents) AS n_reads, count(*) AS n_mapped, count(*) FILTER (g > 1) AS n_multimapped, coalesce(sum(n), 0)::BIGINT AS n_mappings
FROM (SELECT doc_id, count(DISTINCT item_id) AS g, count(*) AS n FROM (SELECT DISTINCT doc_id, start, item_id FROM {TEXT_HITS}) GROUP BY doc_id)""")
def map_stats(spark, sf_dir):
    mapped = text_hits(spark, sf_dir).select(F.col("read_key.doc_id").alias("read_id"), F.col("read_key.start").alias("start"), F.col("win_key").alias("graph_id")).distinct()
    return A.map_stats(D.table(spark, sf_dir, "documents"), mapped)


def aligned_parts(spark, sf_dir):
    index = D.index(spark, sf_dir)
    g, reads = index.graph, D.simulated_reads(spark, sf_dir)
    mappings = P.map_reads(reads, index)
    positions = G.path_positions(g.path_nodes, g.nodes)
    aligned = A.align(reads, mappings, index.contents, g, positions)
    refs = G.sam_references(g.paths, G.path_lengths(g.path_nodes, g.nodes))
    return g, reads, index, mappings, aligned, refs


@query("SELECT read_id, rc, stage, count(*) AS n, count(DISTINCT win_key) AS n_keys, sum(\"offset\")::BIGINT AS offsets FROM cand GROUP BY ALL")
def align_candidates(spark, sf_dir):
    index, reads = D.index(spark, sf_dir), D.simulated_reads(spark, sf_dir)
    tries = A.align_candidates(A.both_strands(reads), P.map_reads(reads, index), index.contents, index.graph.nodes)
    return tries.groupBy("read_id", "rc", "stage").agg(F.count("*").alias("n"), F.countDistinct("win_key").alias("n_keys"), F.sum("offset").cast("long").alias("offsets"))


@query("SELECT DISTINCT graph_id, node_id, \"offset\", array_to_string(trav, ',') AS trav FROM matches")
def dfs_align(spark, sf_dir):
    index, reads = D.index(spark, sf_dir), D.simulated_reads(spark, sf_dir)
    strands = A.both_strands(reads)
    tries = A.align_candidates(strands, P.map_reads(reads, index), index.contents, index.graph.nodes)
    clipped = F.substring(F.col("seq"), F.col("clip_start") + 1, F.length("seq") - F.col("clip_start") - F.col("clip_end"))
    todo = tries.join(strands.select("read_id", "rc", "seq"), ["read_id", "rc"]).select("graph_id", "node_id", long("offset", "offset"), clipped.alias("seq")).distinct()
    return A.dfs_align(todo, index.graph).select("graph_id", "node_id", "offset", joined("trav").alias("trav")).distinct()


@query("SELECT DISTINCT graph_id, \"offset\", array_to_string(trav, ',') AS trav, path_id, start::BIGINT AS start FROM trav_refs")
def traversal_refs(spark, sf_dir):
    index, reads = D.index(spark, sf_dir), D.simulated_reads(spark, sf_dir)
    g, strands = index.graph, A.both_strands(reads)
    tries = A.align_candidates(strands, P.map_reads(reads, index), index.contents, g.nodes)
    clipped = F.substring(F.col("seq"), F.col("clip_start") + 1, F.length("seq") - F.col("clip_start") - F.col("clip_end"))
    todo = tries.join(strands.select("read_id", "rc", "seq"), ["read_id", "rc"]).select("graph_id", "node_id", long("offset", "offset"), clipped.alias("seq")).distinct()
    met = A.dfs_align(todo, g).select("graph_id", "offset", "trav").distinct()
    found = A.traversal_refs(met.withColumn("o", F.col("offset")), ["graph_id", "o"], G.path_positions(g.path_nodes, g.nodes))
    return found.select("graph_id", F.col("o").alias("offset"), joined("trav").alias("trav"), "path_id", long("start", "start"))


@query("SELECT read_id, graph_id, win_key, stage, rank::BIGINT AS rank, path_id, start::BIGINT AS start, nth::BIGINT AS nth FROM aligned WHERE NOT rc")
def align_first(spark, sf_dir):
    return aligned_parts(spark, sf_dir)[4].where("not rc").select("read_id", "graph_id", "win_key", "stage", long("rank", "rank"), "path_id", long("start", "start"), long("nth", "nth"))


@query("SELECT read_id, rc, count(*) AS n FROM aligned GROUP BY ALL")
def align_both_strands(spark, sf_dir):
    return aligned_parts(spark, sf_dir)[4].groupBy("read_id", "rc").agg(F.count("*").alias("n"))


@query("SELECT read_id, graph_id, win_key FROM tried")
def tried_mappings(spark, sf_dir):
    _, _, _, mappings, aligned, _ = aligned_parts(spark, sf_dir)
    return A.tried_mappings(mappings, aligned).select("read_id", "graph_id", "win_key")


@query("SELECT read_id, graph_id, path_id, ref_name, pos, cigar, mapq, flags, seq, qual FROM records")
def sam_records(spark, sf_dir):
    _, reads, _, mappings, aligned, refs = aligned_parts(spark, sf_dir)
    return A.sam_records(A.reported(aligned, A.tried_mappings(mappings, aligned)), reads, refs)


@query("SELECT graph_id, node_id, round(kmer_freq, 6) AS kmer_freq FROM node_weights")
def subpath_weights(spark, sf_dir):
    g, _, index, mappings, aligned, _ = aligned_parts(spark, sf_dir)
    weights, _ = A.subpath_weights(A.tried_mappings(mappings, aligned), index.contents, g.nodes)
    return weights.select("graph_id", "node_id", F.round("kmer_freq", 6).alias("kmer_freq"))


TRUTH = "(SELECT r.read_id, split_part(r.read_id, '_', 3)::INTEGER AS true_start, regexp_extract(split_part(r.read_id, '_', 10), '^[^$ ]*') AS true_ref FROM reads r)"


@query(f"""SELECT count(*) AS n_reads, count(*) FILTER (n > 0) AS n_aligned, count(*) FILTER (n > 1) AS n_multi, count(*) FILTER (n = 0) AS n_unaligned,
count(*) FILTER (n > 0 AND NOT ok) AS n_misaligned, count(*) FILTER (st) AS n_right_start, coalesce(sum(wrong), 0)::BIGINT AS false_positives
FROM (SELECT t.read_id, count(a.ref_name) AS n, coalesce(bool_or(a.ref_name = t.true_ref), FALSE) AS ok, coalesce(bool_or(a.ref_name = t.true_ref AND a.pos = t.true_start), FALSE) AS st, count(*) FILTER (a.ref_name <> t.true_ref) AS wrong
FROM {TRUTH} t LEFT JOIN records a USING (read_id) GROUP BY t.read_id)""")
def accuracy_eval(spark, sf_dir):
    _, reads, _, mappings, aligned, refs = aligned_parts(spark, sf_dir)
    records = A.sam_records(A.reported(aligned, A.tried_mappings(mappings, aligned)), reads, refs)
    t = Q.read_name_truth(F.col("read_id"))
    return R.accuracy(reads.select("read_id", t["ref"].alias("true_ref"), t["start"].alias("true_start")), records)


# --- abundance -----------------------------------------------------------------------------------
@query("SELECT graph_id, node_id, path_id, count FROM ec")
def em_classes(spark, sf_dir):
    return D.line_classes(spark, sf_dir)[0]


@query("SELECT p.graph_id, p.node_id, p.path_id, round(m.kmer_freq / m.seg_len, 6) AS count FROM path_nodes p JOIN made m USING (graph_id, node_id)")
def em_input(spark, sf_dir):
    g = D.graph(spark, sf_dir)
    return E.em_input(g.path_nodes, g.nodes, D.made_weights(g)).withColumn("count", F.round("count", 6))


@query("SELECT graph_id, path_id, round(alpha, 4) AS alpha FROM alpha3")
def em_step(spark, sf_dir):
    ec, paths = D.line_classes(spark, sf_dir)
    alpha = E.start(paths)
    for _ in range(3):
        alpha = E.em_step(ec, alpha)
    return alpha.withColumn("alpha", F.round("alpha", 4))


def _em_sql(least: int, most: int, ec: str = "ec", alpha: str = "alpha0") -> str:
    """state: 0 while shares move, 1 once they rest (small ones are zeroed), 2 after the round that follows."""
    spread = f"SELECT e.graph_id, e.path_id, e.count, r.alpha, sum(r.alpha) OVER (PARTITION BY e.graph_id, e.node_id) AS al FROM {ec} e JOIN em r ON r.graph_id = e.graph_id AND r.path_id = e.path_id WHERE e.count > 0 AND r.state < 2"
    moved = f"SELECT p.graph_id, p.path_id, p.i, p.state, coalesce(n.s, 0)::DOUBLE AS alpha, max(CASE WHEN n.s > 0.01 AND abs(n.s - p.alpha) / n.s > 0.01 THEN 1 ELSE 0 END) OVER (PARTITION BY p.graph_id) AS moves FROM em p LEFT JOIN (SELECT graph_id, path_id, sum(alpha * count / al) AS s FROM ({spread}) WHERE al >= 2.0 ** -52 GROUP BY ALL) n USING (graph_id, path_id) WHERE p.state < 2 AND p.i + 1 < {most}"
    state = f"SELECT *, CASE WHEN state = 1 THEN 2 WHEN moves = 0 AND i + 1 > {least} THEN 1 ELSE 0 END AS next FROM ({moved})"
    return f"""SELECT * FROM (WITH RECURSIVE em AS (SELECT graph_id, path_id, -1 AS i, alpha, 0 AS state FROM {alpha}
      UNION ALL SELECT graph_id, path_id, i + 1, CASE WHEN next = 1 AND alpha < 1e-8 THEN 0 ELSE alpha END, next FROM ({state}))
    SELECT graph_id, path_id, alpha, (CASE WHEN state = 2 THEN i ELSE {most} END)::INTEGER AS iterations FROM em WHERE state = 2 OR i = {most} - 1)"""


@query(f"SELECT graph_id, path_id, round(alpha, 4) AS alpha, iterations FROM ({_em_sql(10, 1000)})")
def em_run(spark, sf_dir):
    ec, paths = D.line_classes(spark, sf_dir)
    return E.em_run(ec, paths, 10, 1000).withColumn("alpha", F.round("alpha", 4))


ABUND = "(SELECT graph_id, path_id, alpha / sum(alpha) OVER (PARTITION BY graph_id) * 1000.0 / 50000.0 AS abundance FROM alpha1)"


@query(f"SELECT graph_id, path_id, round(abundance, 6) AS abundance FROM {ABUND} WHERE abundance >= 0.00285")
def em_abundance(spark, sf_dir):
    ec, paths = D.line_classes(spark, sf_dir)
    em = E.em_step(ec, E.start(paths))
    totals = paths.select("graph_id").distinct().withColumn("kmer_total", F.lit(1000.0))
    return E.em_abundance(em, totals, 50000.0, 0.00285).withColumn("abundance", F.round("abundance", 6))


@query(f"SELECT graph_id, path_id, 'p' || path_id AS name, round(abundance, 6) AS abundance FROM {ABUND}")
def em_paths(spark, sf_dir):
    ec, paths = D.line_classes(spark, sf_dir)
    totals = paths.select("graph_id").distinct().withColumn("kmer_total", F.lit(1000.0))
    named = paths.withColumn("name", F.concat(F.lit("p"), F.col("path_id").cast("string")))
    listed = E.em_paths(E.em_abundance(E.em_step(ec, E.start(paths)), totals, 50000.0, 0.0), named)
    return listed.select("graph_id", "path_id", "name", F.round("abundance", 6).alias("abundance"))


@query(f"""SELECT (SELECT count(DISTINCT graph_id) FROM listed) AS n_graphs, avg(iterations) AS mean_iterations, coalesce(sum(n), 0)::BIGINT AS n_alleles FROM (
  SELECT graph_id, any_value(iterations) AS iterations, count(*) FILTER (alpha / al * kmer_total / (SELECT sum(kmer_total) FROM kmer_totals) >= 1e-4) AS n FROM (
    SELECT *, sum(alpha) OVER (PARTITION BY graph_id) AS al FROM ({_em_sql(10, 1000, 'read_ec', 'read_alpha0')})) LEFT JOIN kmer_totals USING (graph_id) GROUP BY graph_id)""")
def haplotypes(spark, sf_dir):
    """The whole chain on the graphs of the benchmark: weights, pruning, EM and called alleles."""
    index = D.index(spark, sf_dir)
    done = P.align_reads(D.simulated_reads(spark, sf_dir), index)
    totals = done["totals"]
    total = totals.agg(F.sum("kmer_total")).first()[0] or 1.0
    em, called = P.haplotypes(done["graph"], done["paths"], done["weights"], totals, total, 1e-4, 10, 1000)
    return E.haplotypes(em, called)


# --- reports -------------------------------------------------------------------------------------
def line_report(spark, sf_dir, cutoff, low=False):
    return R.report(D.line_alignments(spark, sf_dir), D.line_references(spark, sf_dir), cutoff, low)


@query("SELECT ref_name, pos, depth FROM depths")
def pileup(spark, sf_dir):
    return R.pileup(D.line_alignments(spark, sf_dir), D.line_references(spark, sf_dir))


@query("SELECT ref_name, covered, ref_len, share FROM wide")
def breadth(spark, sf_dir):
    return R.breadth(R.pileup(D.line_alignments(spark, sf_dir), D.line_references(spark, sf_dir)))


@query("SELECT ref_name, cigar FROM cigars")
def coverage_cigar(spark, sf_dir):
    return R.coverage_cigar(R.coverage_runs(R.pileup(D.line_alignments(spark, sf_dir), D.line_references(spark, sf_dir)))).select("ref_name", "cigar")


@query("SELECT ref_name, internal_gap FROM cigars")
def internal_gap(spark, sf_dir):
    return R.coverage_cigar(R.coverage_runs(R.pileup(D.line_alignments(spark, sf_dir), D.line_references(spark, sf_dir)))).select("ref_name", "internal_gap")


REPORT = "SELECT regexp_replace(w.ref_name, '^\\*', '') AS arg, n.read_count, w.ref_len AS gene_length, c.cigar AS coverage_cigar FROM wide w JOIN cigars c USING (ref_name) JOIN line_n n USING (ref_name) WHERE w.share >= "


@query(REPORT + "0.9")
def report(spark, sf_dir):
    return line_report(spark, sf_dir, 0.9)


@query(REPORT + "0.97 AND NOT c.internal_gap")
def report_lowcov(spark, sf_dir):
    return line_report(spark, sf_dir, 0.5, True)


SAMPLES = range(1, 8)  # every line number there is


def sample_report(spark, sf_dir):
    """A report for each line number as a sample, with the length of the reference's name as its status."""
    rows = D.line_alignments(spark, sf_dir).where(F.col("span").isin([30 + 10 * n for n in SAMPLES])).withColumn("sample", ((F.col("span") - 30) / 10).cast("int"))
    return R.report(rows, D.line_references(spark, sf_dir), 0.5, by=("sample",)).withColumn("status", F.length("arg").cast("long"))


def _sample_sql() -> str:
    one = "SELECT {n} AS sample, regexp_replace(ref_name, '^\\*', '') AS arg, any_value(k) AS read_count FROM (SELECT ref_name, any_value(ref_len) AS l, any_value(k) AS k, count(DISTINCT p) AS c FROM (SELECT a.ref_name, r.ref_len, count(*) OVER (PARTITION BY a.ref_name) AS k, a.pos, least(a.pos + a.span, r.ref_len - 1) AS hi FROM line_al a JOIN line_ref r USING (ref_name) WHERE span = {s} AND flags <> 4), LATERAL (SELECT unnest(range(pos, hi + 1)) AS p) GROUP BY ref_name) WHERE c / l >= 0.5 GROUP BY ref_name"
    return " UNION ALL ".join(one.format(n=n, s=30 + 10 * n) for n in SAMPLES)


@query(f"SELECT len(arg)::BIGINT AS status, sum(read_count)::BIGINT AS mapped, count(DISTINCT sample) AS n_samples, sum(read_count) / (1000 * count(DISTINCT sample)) AS share FROM ({_sample_sql()}) GROUP BY len(arg)")
def arg_proportion(spark, sf_dir):
    return R.proportions(sample_report(spark, sf_dir), "status", 1000)


@query(f"SELECT len(arg)::BIGINT AS status, count(*) AS n_rows, count(DISTINCT arg) AS n_args FROM ({_sample_sql()}) GROUP BY len(arg)")
def combined_profiles(spark, sf_dir):
    return R.combined_profiles([sample_report(spark, sf_dir)], "status")


@query("SELECT upper(seq) AS seq, min(doc_id) AS id, count(*) AS copies FROM doc_seq GROUP BY upper(seq)")
def dedup_seqs(spark, sf_dir):
    return R.dedup_sequences(D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), Q.text_to_bases(F.col("text")).alias("seq")))


@query("SELECT cluster, n FROM (SELECT o_custkey AS cluster, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 3")
def core_clusters(spark, sf_dir):
    return R.core_clusters(D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster")))
