"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import ann, chat, divergence, exact_dedup, hmm, jaccard, merkle, mixing, pieces, secrets, token_counts, toxicity, warc
from pagewright.shared import table, write_shared


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = write_shared(mixing.sized(table(spark, sf_dir, "documents")), "mix-sizes")
    return mixing.mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = toxicity.bucket(F.col("doc_id"), 4) != 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    scored = toxicity.score(docs, model)
    held_out = toxicity.bucket(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model_scores(table(spark, sf_dir, "documents"))


TOKENIZERS = "/opt/tokenizers"


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), model)


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ann.search(rows, F.col("id") % 50 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_token_counts(spark: SparkSession, sf_dir: str, path: str = f"{TOKENIZERS}/word_bpe_49k.json") -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.tampered_proofs(table(spark, sf_dir, "documents"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("shown"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_hmm_scores": op3_hmm_scores,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_secret_scan": op6_secret_scan,
    "op7_chat_collapse": op7_chat_collapse,
    "op8_multi_index": op8_multi_index,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_divergence_audit": op13_divergence_audit,
}

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_NORMAL} AS body FROM documents),
        g AS (SELECT body, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
}


def _op6_sql() -> str:
    rules = secrets.BASE + secrets.MORE
    base = len(secrets.BASE)
    parts = []
    for place, r in enumerate(rules):
        rx = r.regex.replace("'", "''")
        before = f"length(regexp_extract(hits[i], '{rx}', 1))" if r.lead else "0"
        parts.append(f"""
        SELECT doc_id, '{r.kind}' AS kind, {place} AS place, i,
               length(gaps[i]) + {before} AS gap, length(hits[i]) - {before} AS len, length(tested[i]) - {before} AS tested
        FROM (SELECT doc_id, gaps, hits, tested, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, string_split_regex(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS hits,
                           regexp_extract_all(text, '{rx}', {r.group}) AS tested
                    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in rules)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
        WITH pieces AS ({" UNION ALL ".join(parts)}),
        spans AS (SELECT doc_id, kind, place, tested, len,
                         sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM pieces),
        kept AS (SELECT *, kind || ':' || (stop - len)::BIGINT || ':' || stop::BIGINT AS item FROM spans
                 WHERE tested >= CASE kind {least} END),
        per_doc AS (SELECT doc_id, {counts}, string_agg(item, ',' ORDER BY stop - len, place) AS spans,
                           string_agg(item, ',' ORDER BY stop - len, place) FILTER (place < {base}) AS own FROM kept GROUP BY doc_id)
        SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)},
               sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN per_doc USING (doc_id)
    """


SQL["op6_secret_scan"] = _op6_sql()

# the base32 digits of a SHA-1 by five bits of its hex digits at a time
_BITS = """list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
            (4 * (position(substr(sha, i, 1) IN '0123456789abcdef') - 1) + 1)::INT, 4)), lambda a, b: a || b)"""

SQL["op2_warc"] = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
    g AS (SELECT body, max(page_id) AS response FROM p GROUP BY body),
    b AS (SELECT page_id, octet_length(encode(p.body)) AS payload_bytes, response, {_BITS} AS bits FROM p JOIN g ON p.body = g.body)
    SELECT page_id, payload_bytes,
           list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * (substr(bits, 5 * i + 1, 1)::INT) + 8 * (substr(bits, 5 * i + 2, 1)::INT)
               + 4 * (substr(bits, 5 * i + 3, 1)::INT) + 2 * (substr(bits, 5 * i + 4, 1)::INT) + (substr(bits, 5 * i + 5, 1)::INT) + 1)::INT, 1)), lambda a, b: a || b) AS payload_digest,
           CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
    FROM b
"""

SQL["op7_chat_collapse"] = r"""
    WITH c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
    firsts AS (SELECT turns, n_turns, min(conv_id) AS first FROM c GROUP BY turns, n_turns),
    prefixes AS (SELECT conv_id, n_turns, list_slice(turns, 1, k) AS turns, k FROM (SELECT *, unnest(range(1, n_turns)) AS k FROM c)),
    holders AS (SELECT turns, k, arg_max(conv_id, (n_turns, -conv_id)) AS holder FROM prefixes GROUP BY turns, k),
    kept AS (SELECT c.conv_id, c.n_turns, c.turns, coalesce(h.holder, f.first) AS kept_by
             FROM c JOIN firsts f ON c.turns = f.turns LEFT JOIN holders h ON h.turns = c.turns AND h.k = c.n_turns)
    SELECT conv_id, n_turns, conv_id = kept_by AS kept, kept_by,
           CASE WHEN conv_id = kept_by THEN 0 END AS part,
           CASE WHEN conv_id = kept_by THEN list_reduce(list_transform(turns, lambda x: '<|im_start|>' || regexp_replace(coalesce(x.r, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || chr(10) || regexp_replace(coalesce(x.t, ''), '<\|(im_start|im_end)\|>', '<| \1 |>', 'g') || '<|im_end|>' || chr(10)), lambda a, b: a || b) END AS text
    FROM kept
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

# Every pair that shares a shingle, verified; classes by walking the links.
SQL["op10_jaccard_join"] = f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM i),
    c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE k >= 0.8 * (cx.n + cy.n - k) - 1e-9),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT x AS doc_id, y AS other FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
    SELECT d.doc_id, least(d.doc_id, coalesce(m.low, d.doc_id)) AS class_id, coalesce(n.n, 0) AS n_links
    FROM documents d LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY 1) m ON m.doc_id = d.doc_id LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY 1) n ON n.x = d.doc_id
"""

# Sources are full up to the first that the level of those after it doesn't fill; then the keys' order and its prefix sums.
SQL["op5_mixing"] = f"""
    WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents),
    z AS (SELECT source, sum(size)::BIGINT AS source_size, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
    o AS (SELECT *, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM z),
    a AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                 sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM o),
    v AS (SELECT min_by((total - filled)::DOUBLE / open::DOUBLE, most / weight) AS level FROM a WHERE most > weight * ((total - filled)::DOUBLE / open::DOUBLE)),
    t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, weight * level) END AS target FROM o, v),
    g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
    k AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
                 1 - pow((('0x' || left(sha256('17:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496,
                         1 / greatest(0.1::DOUBLE, (size::DOUBLE / (size + 20)) / (1 + abs(chars::DOUBLE / greatest(size, 1) - 6.5::DOUBLE) / 6.5::DOUBLE))) AS key
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS after FROM k)
    SELECT doc_id, size, source_size, target,
           (size * (epochs + CASE WHEN size > 0 AND (after <= rest OR after - size < rest AND abs(after - rest) < abs(after - size - rest)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM s
"""


# CRC-32 of a short text of ASCII characters, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _op12_sql(depth: int = 8, above: int = 3) -> str:
    """Trees of up to 8 ** depth leaves, 8 ** above of them: each level from the one below, then every leaf's run on each level."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def field(x: str) -> str:
        return f"CASE WHEN ({x}) IS NULL THEN '-' ELSE octet_length(encode(({x})::VARCHAR)) || ':' || ({x}) END"

    def hashed(body: str) -> str:
        return f"sha256({' || '.join(field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', body))})"

    def levels(name: str, first: str, n: int) -> list[str]:
        made = [f"{name}0 AS ({first})"]
        for k in range(n):
            made.append(f"{name}{k + 1} AS (SELECT tree, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY tree, i // 8, n)")
        for k in range(n):
            run = "OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN"
            made.append(
                f"{name}s{k} AS (SELECT tree, i, n, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo, coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {name}{k})"
            )
        return made

    steps, at = [], "SELECT tree, i, gi, doc_id, leaf, subroot, root, '' AS proof, shown AS folded FROM whole"
    for name, place, tree, n in (("l", "i", "f.tree", depth), ("g", "gi", "''", above)):
        for k in range(n):
            fold = "CASE WHEN s.n = 1 THEN f.folded ELSE sha256(s.lo || f.folded || s.hi) END AS folded"
            at = f"SELECT f.tree, f.i, f.gi, f.doc_id, f.leaf, f.subroot, f.root, f.proof || s.lo || s.hi AS proof, {fold} FROM ({at}) f JOIN {name}s{k} s ON s.tree = {tree} AND s.i = f.{place} // {8**k}"
            steps.append(f"{name}f{k} AS ({at})")
            at = f"SELECT * FROM {name}f{k}"
    return f"""
        WITH named AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {hashed("text")} AS leaf,
                              CASE WHEN {_CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN {hashed(f"translate(text, '{upper}', '{upper.lower()}')")} END AS changed FROM documents),
        base AS (SELECT tree, doc_id, leaf, coalesce(changed, leaf) AS shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM named),
        {", ".join(levels("l", "SELECT tree, i, n, leaf AS d FROM base", depth))},
        ranked AS (SELECT tree AS own, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM l{depth}),
        {", ".join(levels("g", "SELECT '' AS tree, i, n, d FROM ranked", above))},
        whole AS (SELECT b.tree, b.i, r.i AS gi, b.doc_id, b.leaf, b.shown, r.d AS subroot, g.d AS root FROM base b JOIN ranked r ON r.own = b.tree, g{above} g),
        {", ".join(steps)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM ({at})
    """


SQL["op12_merkle_manifest"] = _op12_sql()

# Every kept term of every group, zeros too.
SQL["op13_divergence_audit"] = r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    e AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
    s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
    p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p,
                 1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS q
          FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    both_ AS (SELECT r.lang, r.source, 'pair' AS part, r.item, coalesce(s.value, 0)::BIGINT AS value FROM pairs r LEFT JOIN sums s ON s.lang = r.lang AND s.source = r.source AND s.item = r.item
              UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_) WHERE part = 'pair' OR rank <= 10
"""
