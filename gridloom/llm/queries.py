"""The registered queries of this folder and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from .audio import op6_audio
from .langid import op9_language
from .licenses import op8_licenses
from .mixing import op10_mix
from .near import op4_near
from .packing import op2_pack
from .quality import op7_quality
from .secrets import op1_secrets
from .substrings import op5_substrings
from .topk import op3_topk

QUERIES = {f.__name__: f for f in (op1_secrets, op2_pack, op3_topk, op4_near, op5_substrings, op6_audio, op7_quality, op8_licenses, op9_language, op10_mix)}

SQL = {
    "op3_topk": """
        WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """,
    "op5_substrings": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM p WHERE i + 12 <= len(w)),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS gone FROM g),
        c AS (SELECT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE gone),
        r AS (SELECT p.doc_id, p.i, p.w[p.i] AS word FROM p LEFT JOIN (SELECT DISTINCT doc_id, i FROM c) c USING (doc_id, i) WHERE c.i IS NULL),
        k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM r GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op10_mix": r"""
        WITH RECURSIVE
        r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens, md5(CAST(doc_id AS VARCHAR)) AS place FROM documents),
        n AS (SELECT greatest(1, CAST(ceil(ln(greatest(count(*), 1) / 2048.0) / ln(16)) AS INTEGER)) AS digits FROM r),
        s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY source),
        x AS (SELECT min(tokens) / CAST(max(tokens) AS DOUBLE) AS ratio FROM s WHERE tokens > 0),
        b AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
              SELECT k + 1, CASE WHEN pow(ratio, (lo + hi) / 2 - 1) > 2.0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(ratio, (lo + hi) / 2 - 1) > 2.0 THEN hi ELSE (lo + hi) / 2 END FROM b, x WHERE k < 30),
        a AS (SELECT round(hi, 6) AS exponent FROM b WHERE k = 30),
        u AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens / CAST(sum(tokens) OVER () AS DOUBLE), exponent) ELSE 0 END AS raised FROM s, a),
        w AS (SELECT source, tokens, round(raised / sum(raised) OVER (), 9) AS weight FROM u),
        f AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN greatest(tokens, CAST(floor(round(weight / min(CASE WHEN tokens > 0 THEN weight / tokens END) OVER (), 3)) AS BIGINT)) ELSE 0 END AS budget FROM w),
        e AS (SELECT source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM f),
        d AS (SELECT r.*, substr(place, 1, digits) AS block FROM r, n),
        t AS (SELECT source, block, sum(tokens) AS in_block FROM d GROUP BY source, block),
        o AS (SELECT t.*, epochs, rest, coalesce(sum(in_block) OVER (PARTITION BY t.source ORDER BY md5(epochs || ':' || coalesce(t.source, '') || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source),
        p AS (SELECT d.*, o.epochs, o.rest, o.before, o.in_block, sum(d.tokens) OVER (PARTITION BY d.source, d.block ORDER BY md5(epochs || ':' || doc_id), doc_id, d.tokens ROWS UNBOUNDED PRECEDING) AS running
              FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.block = o.block),
        z AS (SELECT doc_id, source, tokens, CAST(unnest(range(0, epochs)) AS INTEGER) AS epoch, block FROM p
              UNION ALL SELECT doc_id, source, tokens, CAST(epochs AS INTEGER), block FROM p WHERE rest > 0 AND (before + in_block <= rest OR before < rest AND before + running <= rest))
        SELECT *, md5(epoch || ':' || coalesce(source, '') || ':' || block) AS turn, md5(epoch || ':' || doc_id) AS place FROM z
    """,
}

