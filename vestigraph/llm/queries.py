"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vestigraph.llm import chat, decontaminate, exact_dedup, fill_middle, html_text, langid, merkle, packing, pii, simhash, token_counts, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents")).drop("at_file", "at_row")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(_table(spark, sf_dir, "conversations"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_html_extraction, op3_decontamination, op4_simhash, op5_warc, op6_toxicity, op7_exact_dedup, op8_pii, op9_language_id, op10_chat_format,
        op11_token_counts, op12_merkle_manifest, op13_fill_in_middle,
    )
}


def _reduced(prefix: str, source: str, levels: int) -> str:
    """Trees of fan-out 16 over (g, r, n, hash) rows, a level in each common table; a group of one node stays as it is. {prefix}_s has the left and right siblings of each node and level, {prefix}_t what remains."""
    out = [f"{prefix}0 AS MATERIALIZED (SELECT g, r, n, hash FROM {source})"]
    for k in range(levels):
        out.append(f"""{prefix}{k + 1} AS MATERIALIZED (SELECT g, r // 16 AS r, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY r)) END AS hash FROM {prefix}{k} GROUP BY g, r // 16)""")
    sides = " UNION ALL ".join(
        f"""SELECT g, r, {k} AS level, CASE WHEN n > 1 THEN coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
            CASE WHEN n > 1 THEN coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS h
            FROM {prefix}{k} WINDOW w AS (PARTITION BY g, r // 16 ORDER BY r)"""
        for k in range(levels)
    )
    return ", ".join([*out, f"{prefix}_s AS MATERIALIZED ({sides})", f"{prefix}_t AS (SELECT g, hash FROM {prefix}{levels})"])


def _merkle_sql(levels: int = 6) -> str:
    """For at most 16 to the power of `levels` documents a source, and as many sources."""
    field = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
    before = " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32, bit by bit
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)), lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda i: i)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    joins = " ".join(f"LEFT JOIN a_s a{k} ON a{k}.g = d.g AND a{k}.r = d.r // {16**k} AND a{k}.level = {k}" for k in range(levels))
    joins += " JOIN bx AS up ON up.src = d.g " + " ".join(f"LEFT JOIN b_s b{k} ON b{k}.r = up.r // {16**k} AND b{k}.level = {k}" for k in range(levels))
    levels_of = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(levels)]
    steps, last = [], "told"
    for s in levels_of:
        steps.append(f"CASE WHEN {s}l IS NULL THEN {last} ELSE sha256({s}l || {last} || {s}h) END AS f{s}")
        last = f"f{s}"
    sides = ", ".join(f"{s}.l AS {s}l, {s}.h AS {s}h" for s in levels_of)
    proof = " || ".join(f"coalesce({s}l || {s}h, '')" for s in levels_of)
    return f"""
        WITH d0 AS MATERIALIZED (SELECT doc_id, coalesce(':' || source, '-') AS g, sha256({before} || {field.format("text")}) AS leaf,
                           CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({before} || {field.format(low)}) ELSE sha256({before} || {field.format("text")}) END AS told FROM documents),
        d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM d0),
        leaves AS (SELECT g, r, n, leaf AS hash FROM d), {_reduced("a", "leaves", levels)},
        bx AS MATERIALIZED (SELECT g AS src, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n, hash FROM a_t),
        tops AS (SELECT 0 AS g, r, n, hash FROM bx), {_reduced("b", "tops", levels)},
        j AS (SELECT d.doc_id, d.leaf, d.told, up.hash AS subroot, (SELECT hash FROM b_t) AS root, {sides} FROM d {joins}),
        f AS (SELECT *, {", ".join(steps)} FROM j)
        SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {last} AS folded_root, {last} = root AS verified FROM f
    """


ORACLES: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS stays FROM p)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
               CASE WHEN page_id = stays THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> stays THEN stays END AS refers_to
        FROM q
    """,
    "op3_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM win),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        hit AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM pos, sizes WHERE i + size - 1 <= len(w)),
        found AS (SELECT doc_id, i, win.size, item_id FROM hit JOIN win USING (g, size)),
        covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
               sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items t USING (doc_id)
    """,
    "op12_merkle_manifest": _merkle_sql(),
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        c AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
                     array_to_string(u[1 : least(h1, h2)], '') AS p, array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1 :], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM f
    """,
}
