"""The text operators as named queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import bitplanes, codes, html_text, lattice, licences, minhash, mixing, pieces, prefix_trie, privacy, secrets, toxicity
from tickweave.llm import quality as rules
from tickweave.llm.common import ROW, table
from tickweave.session import shared_folder


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of each document; its smallest doc_id is kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of each document."""
    rows = licences.scanned(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts, n = F.col("places.start"), F.size("places").cast("long")
    best = F.greatest(F.when(n > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("blocks.share"), F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "blocks.label")).alias("labels"), best.alias("score"), F.size("blocks").cast("long").alias("n_blocks"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    rows = secrets.scanned(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    said = lambda c: F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.stop))
    rank = lambda s: F.when(s.kind == "assign", 0).when(s.kind == "access", 1).when(s.kind == "hex", 2).otherwise(3)
    keyed = lambda c: F.transform(c, lambda s: F.struct(s.start.alias("start"), rank(s).alias("rank"), s.stop.alias("stop"), s.kind.alias("kind")))
    every = F.array_join(said(F.sort_array(F.concat(keyed("base"), keyed("values")))), ",")
    return rows.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(F.array_join(said("base"), ","), 256).alias("base_sha256"), every.alias("spans"), F.size("values").cast("long").alias("n_guess"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of the sources; ``draws`` says to which shards."""
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.taken)
    return mixing.draws(table(spark, sf_dir, "documents")).select(f"{ROW}.doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of each document's whole text, and whether decoding them gives the text back."""
    rows = pieces.with_round_trip(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_pieces", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "round_trip", "ids")


def op8_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict for each document."""
    done = rules.quality(table(spark, sf_dir, "documents"))
    return done.select(f"{ROW}.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of each document, and counts of each kind."""
    rows = privacy.personal_data(table(spark, sf_dir, "documents"))
    said = lambda c: F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.stop))
    kinds = [f"{k}_spans" for k in privacy.PATTERNS]
    base = F.array_join(F.concat(*[said(F.col(c)) for c in kinds]), ",")
    every = F.array_join(F.concat(*[said(F.col(c)) for c in [*kinds, "term_spans"]]), ",")
    return rows.select(
        f"{ROW}.doc_id", *[F.size(c).cast("long").alias("n_" + c.removesuffix("_spans")) for c in kinds], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
        F.size("term_spans").cast("long").alias("n_term"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each vector, its squared distance, inertia and digest of the centroid."""
    return bitplanes.with_inertia(*bitplanes.clusters(table(spark, sf_dir, "embeddings")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's token ids, read back from the files written."""
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    codes.write(table(spark, sf_dir, "documents"), folder)
    return codes.read(spark, folder)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def _clusters_sql() -> str:
    """Each round as two common table expressions: the assignment and the moved centroids."""
    steps = ["""
        q AS (
            SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS INTEGER) AS cluster, v AS c FROM q QUALIFY cluster < 16)"""]
    for k in range(bitplanes.ROUNDS + 1):
        steps.append(f"""
        far{k} AS (SELECT vec_id, v, cluster, list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS d FROM q, c{k}),
        a{k} AS (SELECT vec_id, v, cluster, CAST(d AS BIGINT) AS distance FROM far{k} QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, cluster) = 1)""")
        if k < bitplanes.ROUNDS:
            steps.append(f"""
        u{k} AS (SELECT cluster, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{k}),
        s{k} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{k} GROUP BY ALL),
        m{k} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY cluster),
        c{k + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (cluster))""")
    last = bitplanes.ROUNDS
    return "WITH" + ",".join(steps) + f"""
        SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{last} JOIN c{last} USING (cluster)"""


_CLUSTERS = _clusters_sql()
_TRIE = """
    WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    crc AS (
        SELECT conv_id, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda u, w: xor(u >> 1, 3988292384 * (u & 1))))) % 6 AS BIGINT) AS h
        FROM ids),
    own AS (
        SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS t
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    re AS (
        SELECT o.conv_id, list_concat(coalesce(s.t[1:c.h], o.t[1:0]), o.t[c.h + 1:]) AS t FROM own o JOIN crc c USING (conv_id) LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 100),
    p AS (SELECT conv_id, d AS depth, t[1:d] AS prefix, len(t) AS n, CASE WHEN d = 0 THEN 0 ELSE length(t[d].text) END AS chars FROM re, unnest(range(0, len(t) + 1)) AS r(d)),
    g AS (
        SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS childless, any_value(chars) AS chars,
            sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
        FROM p GROUP BY depth, prefix),
    below AS (
        SELECT p.prefix AS prefix, p.depth AS depth, count(*) FILTER (g.childless) AS n_leaves, sum((g.n_convs - 1) * g.chars) AS saved, count(*) FILTER (g.depth = p.depth + 1) AS n_children
        FROM g JOIN p ON p.conv_id = g.conv_id AND p.depth <= g.depth GROUP BY ALL)
    SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(g.n_convs AS BIGINT) AS n_convs, CAST(b.n_children AS BIGINT) AS n_children,
        CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, g.ends_sha256
    FROM g JOIN below b ON b.depth = g.depth AND b.prefix = g.prefix LEFT JOIN g up ON up.depth = g.depth - 1 AND up.prefix = g.prefix[1:g.depth - 1]"""

QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_license_scan, op3_toxicity, op4_secret_scan, op5_mix_sources, op6_html_text, op7_sentencepiece, op8_near_duplicate_vectors, op9_quality_rules, op10_personal_data, op11_centroid_clusters, op12_token_files, op13_prefix_trie)}
ORACLES: dict[str, str] = {
    "op1_near_duplicates": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM d),
        x AS (SELECT doc_id, unnest(s) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT p.a, p.b FROM pairs p JOIN sets m ON m.doc_id = p.a JOIN sets n ON n.doc_id = p.b WHERE 100 * p.k >= 80 * (len(m.s) + len(n.s) - p.k)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id),
        low AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM sets s JOIN low l ON l.id = s.doc_id""",
    "op8_near_duplicate_vectors": """
        WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        good AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
        low AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
        FROM e JOIN low l ON l.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op11_centroid_clusters": _CLUSTERS,
    "op13_prefix_trie": _TRIE,
}
