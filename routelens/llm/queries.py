"""Registered queries of the training-data operators and their DuckDB twins.

Each query reads whole tables through its operator with production parameters.  Operators whose
result SQL cannot state (tokenizers, the licence parser, a fitted model) have no twin; tests compare
them with brute force, round trips and held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, chat_repair, embed_dedup, language_id, license_scan, minhash_dedup, mixing, packing,
               prefix_trie, suffix_dedup, token_files, topk, toxicity)
from .tokens import vocabulary_path

WINDOW_TOKENS, PACK_END, FILE_END = 2048, 1, 0
MIX = {"exponent": 0.5, "epochs": 1.0, "seed": 1}
PROBE = "</s>[INST] ok [/INST]"
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids by minimum bin slack."""
    return packing.pack(_table(spark, sf_dir, "documents"), WINDOW_TOKENS, vocabulary_path(), PACK_END)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and expressions of every document."""
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -1 as prefix-target examples, read back from the formatted text."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.format_examples(turns.unionByName(probe)))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector against all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024.0)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 and their components over all vectors."""
    return embed_dedup.embedding_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that smaller documents hold too, removed."""
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"), width=50)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    return token_files.token_files(spark, _table(spark, sf_dir, "documents"), FILE_END)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components at similarity 0.75 of five-word shingles."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=5, percent=75)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated towards the square root of their sources' sizes, in a global random order."""
    docs = _table(spark, sf_dir, "documents")
    return mixing.mixed(docs, **MIX).select(*docs.columns, "mix_count", "mix_copy", "mix_order")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.node_report(_table(spark, sf_dir, "conversations"), every=20, most=3)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from the labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged and repaired with the least edits."""
    return chat_repair.repair_report(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


SQL["op3_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role = 'assistant' AS train,
             length(role) - length(translate(role, '\<[' || chr(10), ''))
             + length(text) - length(translate(text, '\<[', '')) + length(role) + length(text)
             + CASE WHEN role = 'assistant' THEN 8 ELSE 17 END AS n FROM t),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (train), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (train), '')) AS loss_sha256,
       sum(upto) FILTER (train OR from_end = 1)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

SQL["op4_topk"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id != q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

SQL["op5_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                     WHERE embedding IS NOT NULL AND len(embedding) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id != b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

SQL["op6_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s),
r AS (SELECT w.doc_id, i FROM w JOIN f ON w.s = f.s WHERE low < w.doc_id),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM r)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM g GROUP BY doc_id, k),
gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM spans),
per AS (SELECT g.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed,
               string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo)
               || substr(any_value(h), 2 * max(hi)::BIGINT + 1) AS kept
        FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN per ON d.doc_id = per.doc_id
"""

SQL["op9_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) >= 5 THEN len(w) - 3 WHEN len(w) > 0 THEN 2 ELSE 1 END)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

SQL["op10_mixing"] = """
WITH RECURSIVE s AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
w AS (SELECT source, chars, round(pow(chars::DOUBLE, 0.5) * 1e6) AS weight FROM s),
t AS (SELECT sum(chars)::DOUBLE AS total, sum(weight::DECIMAL(38, 0))::DOUBLE AS mass FROM w),
r AS (SELECT source, CASE WHEN chars = 0 OR total = 0 THEN 1.0::DOUBLE ELSE weight / mass * 1.0::DOUBLE * total / chars END AS rate
      FROM w, t),
cdf AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
        UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
        WHERE k + 1 <= floor(rate + 12 * sqrt(rate) + 20)),
u AS (SELECT *, ('0x' || substr(md5('1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS u
      FROM documents),
n AS (SELECT u.doc_id, u.source, u.u, count(*)::BIGINT AS mix_count
      FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= u.u GROUP BY ALL)
SELECT d.*, n.mix_count, x.copy AS mix_copy,
       ('0x' || substr(md5('2|' || coalesce(d.doc_id::VARCHAR, '') || '|' || x.copy), 1, 13))::BIGINT
         / 4503599627370496::DOUBLE AS mix_order
FROM documents d JOIN n ON n.doc_id = d.doc_id
     JOIN (SELECT doc_id, unnest(range(1, mix_count + 1)) AS copy FROM n) x ON x.doc_id = d.doc_id
"""

# the table of CRC-32 (reflected polynomial 0xEDB88320) and, per string, its checksum as an unsigned number
_CRC_TABLE = """(SELECT list(list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)
                            ORDER BY b) AS crc FROM (SELECT unnest(range(256)) AS b))"""


def _crc(text: str) -> str:
    """CRC-32 of ASCII text, with ``_CRC_TABLE`` in scope."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), "
            "lambda h, c: xor(h >> 8, crc[xor(h & 255, c) + 1]), 4294967295), 4294967295)")


SQL["op11_prefix_trie"] = rf"""
WITH own AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
             FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc('conv_id::VARCHAR')} % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), {_CRC_TABLE}),
turns AS (SELECT i.conv_id, 0 AS part, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.pos <= i.h
          UNION ALL SELECT i.conv_id, 1, o.pos, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.pos > i.h),
seqs AS (SELECT i.conv_id, coalesce(t.seq, []) AS seq FROM ids i LEFT JOIN
         (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY part, pos) AS seq FROM turns GROUP BY 1) t USING (conv_id)),
prefixes AS (SELECT conv_id, d, seq[1:d] AS p, len(seq) = d AS ends FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM seqs)),
nodes AS (SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY p),
valued AS (SELECT *, p[1:depth - 1] AS parent, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(
           substr(p[-1], strpos(p[-1], ':') + 1 + split_part(p[-1], ':', 1)::BIGINT), '[^ 	-]+')) END AS saved FROM nodes),
kids AS (SELECT parent AS p, count(*) AS n FROM valued WHERE depth > 0 GROUP BY 1),
below AS (SELECT p[1:i] AS p, sum(saved) AS saved, count(*) FILTER (childless) AS n_leaves
          FROM (SELECT v.p, v.saved, k.n IS NULL AS childless, unnest(range(0, v.depth + 1)) AS i FROM valued v LEFT JOIN kids k ON v.p = k.p) GROUP BY 1)
SELECT v.conv_id, v.depth::BIGINT AS depth, CASE WHEN v.depth > 0 THEN up.conv_id END AS parent_conv_id, v.n_convs,
       coalesce(k.n, 0)::BIGINT AS n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN below b ON b.p = v.p LEFT JOIN kids k ON k.p = v.p LEFT JOIN nodes up ON up.p = v.parent
"""

# the edits of one row: from state (0 nothing yet, 1 after s, 2 after u, 3 after a) to state; insertions first
SQL["op13_chat_repair"] = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, {_CRC_TABLE}),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
         FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM raw WHERE kind <> 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                  right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM hurt),
marked AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prev,
             CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                  WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pos > 1 AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
          (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:']),
          (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 10, 'II', ['assistant:', 'user:']),
          (3, 3, 10, 'II', ['user:', 'assistant:'])) t(s0, s1, c, a, o)),
step AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(s1, i, s2)),
ways AS (SELECT m.conv_id, m.pos, ins.s0, ins.s1 AS s2, ins.c + 2 AS c, ins.a || 'D' AS a, ins.o FROM marked m, ins
         UNION ALL SELECT m.conv_id, m.pos, ins.s0, step.s2, ins.c + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, ins.a || 'K',
                list_append(ins.o, m.role || ':' || m.text) FROM marked m, ins JOIN step USING (s1) WHERE step.i = m.initial AND fault IN ('', 'truncated')
         UNION ALL SELECT m.conv_id, m.pos, ins.s0, step.s2, ins.c + 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, ins.a || 'R',
                list_append(ins.o, CASE step.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || m.text)
                FROM marked m, ins JOIN step USING (s1) WHERE step.i <> 's' AND fault IN ('', 'truncated')),
least AS (SELECT conv_id, pos, s0, s2, min(struct_pack(c := c, a := a, o := o)) AS w FROM ways GROUP BY ALL),
path AS (SELECT conv_id, 0::BIGINT AS pos, 0 AS s, struct_pack(c := 0, a := '', o := []::VARCHAR[]) AS w FROM counts
         UNION ALL
         SELECT p.conv_id, p.pos + 1, l.s2, min(struct_pack(c := p.w.c + l.w.c, a := p.w.a || l.w.a, o := list_concat(p.w.o, l.w.o)))
         FROM path p JOIN least l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.pos = p.pos + 1 AND l.s0 = p.s GROUP BY 1, 2, 3),
ended AS (SELECT p.conv_id, min(struct_pack(c := p.w.c + t.c, a := p.w.a || t.a, o := list_concat(p.w.o, t.o))) AS w
          FROM path p JOIN counts n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.pos
          JOIN (VALUES (0, 0, '', []), (1, 10, 'II', ['user:', 'assistant:']), (2, 5, 'I', ['assistant:']), (3, 0, '', [])) t(s, c, a, o) ON t.s = p.s
          GROUP BY p.conv_id)
SELECT i.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
       coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(e.w.c, 0)::BIGINT AS cost, coalesce(e.w.a, '') AS audit,
       sha256(coalesce(array_to_string(e.w.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM i.conv_id
     LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_license_scan, op3_chat_format, op4_topk, op5_embedding_dedup,
                                    op6_suffix_dedup, op7_toxicity, op8_token_files, op9_minhash_dedup, op10_mixing,
                                    op11_prefix_trie, op12_language_id, op13_chat_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
