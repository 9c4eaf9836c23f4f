"""The registered queries, on whole tables, and the SQL that says the same where SQL can.

How each treats nulls, empty and very long texts, ties, repeated rows, empty
tables and further columns is stated at the operator it applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import conversation_repair, decontam, exact_dedup, langid, lattice_lm, license_scan, merkle, packing, pii_crf, simhash, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=5)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_report(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packer on instruction data, where all three limits bind."""
    return packing.pack_conversations(_table(spark, sf_dir, "conversations"), tokenizer_path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_suffix_dedup, op3_simhash, op4_license_scan, op5_pii, op6_warc, op7_exact_dedup, op8_packing,
        op8_packing_conversations, op9_language_id, op10_lm_score, op11_merkle, op12_conversation_repair, op13_token_counts,
    )
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _canonical_sql(column: str) -> str:
    t = f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    t = f"regexp_replace({t}, '(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[^\\n]*$', ' ', 'g')"
    t = f"(' ' || regexp_replace({t}, '[^a-z0-9]+', ' ', 'g') || ' ')"
    for old, new in license_scan.SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    return f"trim({t})"


def _license_sql() -> str:
    quoted = lambda rows: ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in rows)
    return f"""
WITH known AS (SELECT digest, min(l) AS license_id FROM (SELECT sha256({_canonical_sql("t")}) AS digest, l FROM (VALUES {quoted(license_scan.known_texts())}) k(l, kind, t) UNION ALL SELECT digest, l FROM (VALUES {quoted(license_scan.LONG_TEXTS)}) x(l, kind, digest)) GROUP BY 1),
docs AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
hits AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n
         FROM (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM lines) x JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license_id, coalesce(h.line_licenses, '') AS line_licenses, coalesce(h.n, 0) AS n_license_lines
FROM docs d LEFT JOIN known k USING (digest) LEFT JOIN hits h USING (doc_id)"""


#: Words of texts; item windows of ten words or fewer; phrases at their places; all terms of a window within 15 words (or its size and 5).
DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, w[i + 1 : i + 10] AS t, len(w[i + 1 : i + 10]) AS n FROM iw, LATERAL (SELECT unnest(range(greatest(1, len(w) - 9))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (SELECT doc_id, i, n, w[i + 1 : i + n] AS t FROM dw, sizes, LATERAL (SELECT unnest(range(greatest(0, len(w) - n + 1))) AS i)),
hit AS MATERIALIZED (SELECT doc_id, i, gram.n AS n, item_id FROM gram JOIN win USING (t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1),
term AS MATERIALIZED (SELECT t, n, unnest(list_distinct(t)) AS term, len(list_distinct(t)) AS k FROM (SELECT DISTINCT t, n FROM win)),
has AS MATERIALIZED (SELECT doc_id, t, any_value(n) AS n, any_value(k) AS k FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM dw) JOIN term USING (term) GROUP BY doc_id, t HAVING count(*) = any_value(k)),
place AS MATERIALIZED (SELECT has.doc_id, has.t, has.n, has.k, p.pos, p.term FROM has JOIN (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM dw) p ON p.doc_id = has.doc_id AND list_contains(has.t, p.term)),
near AS (SELECT DISTINCT a.doc_id, a.t FROM place a JOIN place b ON a.doc_id = b.doc_id AND a.t = b.t AND b.pos >= a.pos AND b.pos < a.pos + a.n + 5 GROUP BY a.doc_id, a.t, a.pos HAVING count(DISTINCT b.term) = any_value(a.k)),
close AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM near JOIN win USING (t) GROUP BY 1)
SELECT dw.doc_id, len(coalesce(w, [])) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN close USING (doc_id)""".replace("{0}", LOWER)

#: Texts as hexadecimal digits, two a byte; strings of 200 bytes by their MD5.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bl AS (SELECT doc_id, b, substr(h, 4000 * b + 1, 4398) AS t, least(2000, length(h) // 2 - 199 - 2000 * b) AS n FROM d, LATERAL (SELECT unnest(range((length(h) // 2 + 1800) // 2000)) AS b)),
s AS MATERIALIZED (SELECT doc_id, 2000 * b + unnest(range(n)) AS i, unnest(list_transform(range(n), lambda j: md5(substr(t, 2 * j + 1, 400)))) AS m FROM bl),
r AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM s WHERE m IN (SELECT m FROM r)),
c AS (SELECT doc_id, i, sum(CASE WHEN step <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
sp AS (SELECT doc_id, k, min(i) AS lo, max(i) + 200 AS hi FROM c GROUP BY 1, 2),
cut AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since, hi, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) IS NULL AS last FROM sp),
kept AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || any_value(substr(h, 2 * hi + 1)) FILTER (last) AS rest FROM cut JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"


def _crc32_sql(text: str) -> str:
    """CRC-32 of a string of ASCII characters, not empty; beside the one row of CRC_TABLE."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


def _merkle_sql(levels: int = 5, group_levels: int = 3) -> str:
    """Trees of up to 16 ** levels leaves, and 16 ** group_levels groups."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes = [
        CRC_TABLE,
        f"""leaf AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256({head} || {field("text")}) AS h,
  CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN sha256({head} || {field(lower)}) END AS bent FROM documents, crc)""",
        "a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaf)",
        "a_l0 AS (SELECT g, i, h, n FROM a)",
    ]

    def tree(name: str, top: int) -> None:
        for k in range(top):
            ctes.append(f"{name}_r{k} AS MATERIALIZED (SELECT g, i // 16 AS run, list(h ORDER BY i) AS kids, any_value(n) AS n FROM {name}_l{k} WHERE n > 1 GROUP BY 1, 2)")
            ctes.append(f"{name}_l{k + 1} AS (SELECT g, run AS i, sha256(array_to_string(kids, '')) AS h, (n + 15) // 16 AS n FROM {name}_r{k})")
        ctes.append(f"{name}_top AS MATERIALIZED ({' UNION ALL '.join(f'SELECT g, h FROM {name}_l{k} WHERE n = 1' for k in range(top + 1))})")

    tree("a", levels)
    ctes.append("b AS MATERIALIZED (SELECT '' AS g, g AS tree, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a_top)")
    ctes.append("b_l0 AS (SELECT g, i, h, n FROM b)")
    tree("b", group_levels)
    joins, steps = [], []
    for name, at, key, top in (("a", "a.i", "a.g", levels), ("b", "b.i", "b.g", group_levels)):
        for k in range(top):
            r = f"{name}_r{k}"
            joins.append(f"LEFT JOIN {r} ON {r}.g = {key} AND {r}.run = {at} // {16 ** (k + 1)}")
            steps.append((f"{r}.kids", f"({at} // {16**k} % 16)"))
    rest = lambda kids, pos: f"{kids}[1:{pos}] || {kids}[{pos} + 2:]"
    ctes.append(
        "p0 AS MATERIALIZED (SELECT a.doc_id, a.h AS leaf, a.bent, b.h AS subroot, b_top.h AS root, sha256("
        + " || ".join(f"coalesce(array_to_string({rest(kids, pos)}, ''), '')" for kids, pos in steps)
        + ") AS proof_sha256, [{}] AS kids, [{}] AS pos FROM a JOIN b ON b.tree = a.g, b_top {})".format(", ".join(kids for kids, _ in steps), ", ".join(f"{pos}" for _, pos in steps), " ".join(joins)).replace("FROM a JOIN b ON b.tree = a.g, b_top", "FROM a JOIN b ON b.tree = a.g JOIN b_top ON b_top.g = b.g")
    )
    acc = "coalesce(bent, leaf)"
    for k in range(1, len(steps) + 1):
        ctes.append(f"f{k} AS (SELECT * EXCLUDE ({'acc' if k > 1 else 'bent'}), CASE WHEN kids[{k}] IS NULL THEN {acc} ELSE sha256(array_to_string(kids[{k}][1:pos[{k}]] || [{acc}] || kids[{k}][pos[{k}] + 2:], '')) END AS acc FROM {f'f{k - 1}' if k > 1 else 'p0'})")
        acc = "acc"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, acc AS folded_root, acc = root AS verified FROM f{len(steps)}"


def _repair_sql() -> str:
    """Suffixes of edits as strings of nine digits of cost and the edits' letters, whose least is the cheapest and then the ASCII-least; from the last row to the first, by state of the pattern."""
    far = "'900000000'"
    add = lambda cost, letter, x: f"lpad((substr({x}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{letter}' || substr({x}, 10)"
    made = (2, 2, 3, 2)

    def closed(base: list[str]) -> str:
        user, assistant = f"least({base[2]}, {add(2, 'I', base[3])})", f"least({base[3]}, {add(2, 'I', base[2])})"
        return f"SELECT conv_id, i, least({base[0]}, {add(2, 'I', 'u')}) AS s0, least({base[1]}, {add(2, 'I', 'u')}) AS s1, u AS s2, a AS s3 FROM (SELECT *, {user} AS u, {assistant} AS a FROM"

    def state(s: int) -> str:
        keeps = {0: ("s", 1), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[s]
        keep = f"CASE WHEN k = '{keeps[0]}' THEN {add('cut', 'K', f's{keeps[1]}')}" + (f" WHEN k = 'u' THEN {add('cut', 'K', 's2')}" if s == 0 else "") + f" ELSE {far} END"
        return f"least({add(3, 'D', f's{s}')}, CASE WHEN doomed THEN {far} ELSE least({add('2 + cut', 'R', f's{made[s]}')}, {keep}) END) AS b{s}"

    base = ["b0", "b1", "b2", "b3"]
    return rf"""
WITH RECURSIVE {CRC_TABLE},
own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM own WHERE kind > 0),
bare AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, left(role, 1) AS c FROM hurt),
sorted AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS i FROM bare),
rows AS MATERIALIZED (SELECT conv_id, i, turn, role, text, c, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM sorted),
letters AS MATERIALIZED (SELECT conv_id, i, blank OR duplicate AS doomed, truncated::INT AS cut, c AS k FROM rows),
counts AS MATERIALIZED (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY 1),
layer AS ({closed(base)} (SELECT conv_id, n AS i, '000000000' AS b0, {far} AS b1, {far} AS b2, '000000000' AS b3 FROM counts))
UNION ALL {closed(base)} (SELECT l.conv_id, l.i - 1 AS i, {", ".join(state(s) for s in range(4))} FROM layer l JOIN letters t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i))),
best AS MATERIALIZED (SELECT conv_id, substr(s0, 1, 9)::BIGINT AS cost, substr(s0, 10) AS audit FROM layer WHERE i = 0),
edits AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM best WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS q FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
done AS (SELECT x.conv_id, p, q, e, r.role, r.text, max((q = 1 AND e = 'K' AND r.c = 's')::INT) OVER (PARTITION BY x.conv_id) AS s FROM placed x LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.i = x.i AND e <> 'I' WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (q - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM done GROUP BY 1)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(t.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES = {
    "op11_merkle": _merkle_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op1_decontamination": DECONTAMINATION,
    "op2_suffix_dedup": REPEATS,
    "op4_license_scan": _license_sql(),
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT html, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN m.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top <> p.page_id THEN m.top END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html AND p.n >= 1000""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""",
}
