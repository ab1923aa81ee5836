"""The same rows in DuckDB SQL for the queries that SQL can express. The others need hashes or scanners that SQL lacks."""

from .chat import Template
from .mixing import GOLDEN, UNIT

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(column: str, t: Template = Template()) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in t.control:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 32766, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 32767, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, {_escaped("role")} AS er, {_escaped("text")} AS et FROM c),
 o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS opens FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, et)),
 g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
   coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
   CAST(sum(length(et) + CASE WHEN opens THEN length('<|:|>') + length(er) + length('<|end|>') ELSE length('<|more|>') END) AS BIGINT) AS formatted_chars FROM o GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

MIX = f"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY 1),
 w AS (SELECT *, ([5, 2, 1])[(k - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM s),
 r AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weight FROM w),
 f AS (SELECT *, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS full_, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS used FROM r
   WINDOW o AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, (total - full_) / (all_weight - used) AS level FROM f),
 b AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio >= level),
 t AS (SELECT source, k, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM b), 0.0) * weight) AS target FROM l),
 v AS (SELECT source, k, CAST(floor(target) AS BIGINT) AS want, (CAST(floor(target) AS BIGINT) + 255) // 256 AS blocks FROM t WHERE target >= 1),
 u AS (SELECT *, CAST(sum(blocks) OVER () AS BIGINT) AS n, CAST(floor(CAST(sum(want) OVER (ORDER BY k) AS BIGINT) / CAST(sum(want) OVER () AS BIGINT) * {UNIT}) AS BIGINT) AS high FROM v),
 x AS (SELECT *, coalesce(lag(high) OVER (ORDER BY k), 0) AS low FROM u),
 p AS (SELECT slot, CAST((CAST(slot AS HUGEINT) * {GOLDEN}) % {UNIT} AS BIGINT) AS point FROM (SELECT unnest(range(CAST((SELECT max(n) FROM u) AS BIGINT))) AS slot)),
 hit AS (SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM p JOIN x ON point >= low AND point < high),
 late AS (SELECT k, n, unnest(range(coalesce((SELECT count(*) FROM hit WHERE hit.k = x.k), 0), blocks)) AS rank FROM x),
 sl AS (SELECT k, slot, rank FROM hit UNION ALL SELECT k, n + rank, rank FROM late),
 po AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
 a AS (SELECT po.*, t.k, source_size, target, CAST(floor(target) AS BIGINT) AS want FROM po JOIN t ON po.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, a.source, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE want // source_size * size + greatest(0, least(size, want - want // source_size * source_size - start)) END AS taken,
  CASE WHEN size > 0 AND start < want THEN sl.slot END AS first_slot
 FROM a LEFT JOIN sl ON sl.k = a.k AND sl.rank = start // 256"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT row, unnest(regexp_extract_all(t, '{WORD}')) AS x, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS i FROM d),
 g AS (SELECT row, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
 twice AS (SELECT row, i FROM g WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, x, y, z) > 1),
 rep AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
 nw AS (SELECT row, count(*) AS n_words FROM w GROUP BY 1),
 li AS (SELECT row, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
 ln AS (SELECT row, source, t, line, len(regexp_extract_all(line, '{WORD}')) AS words, trim(regexp_replace(translate(line, '{UPPER}123456789', '{LOWER}000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
   FROM li WHERE regexp_matches(line, '{WORD}')),
 dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY 1),
 hd AS (SELECT source, count(DISTINCT t) AS n_docs FROM d GROUP BY 1),
 fr AS (SELECT ln.source, norm FROM ln JOIN hd ON ln.source IS NOT DISTINCT FROM hd.source GROUP BY 1, 2
   HAVING count(DISTINCT t) > 4 AND count(DISTINCT t) > least(max(n_docs) * 0.1, 1000)),
 lost AS (SELECT row, CAST(sum(words) AS BIGINT) AS gone FROM ln JOIN fr ON ln.source IS NOT DISTINCT FROM fr.source AND ln.norm = fr.norm GROUP BY 1),
 m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS gone
   FROM d LEFT JOIN nw USING (row) LEFT JOIN rep USING (row) LEFT JOIN dup USING (row) LEFT JOIN lost USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * (n_words - gone) >= 3 * n_words AS kept FROM m"""

UNIT_RE = "[A-Za-z]+|[^A-Za-z]"
FIM = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
 u AS (SELECT *, regexp_extract_all(text, '{UNIT_RE}') AS units, [CAST('0x' || h[1:8] AS BIGINT), CAST('0x' || h[9:16] AS BIGINT), CAST('0x' || h[17:24] AS BIGINT), CAST('0x' || h[25:32] AS BIGINT)] AS d FROM t),
 n AS (SELECT *, CAST(len(units) AS BIGINT) AS n FROM u),
 c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
 p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def _codes_sql(rounds: int = 2) -> str:
    steps = ["""kept AS (SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, len(embedding) // 16 AS w FROM embeddings
   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
     "p AS MATERIALIZED (SELECT vec_id, label, part, w, v[part * w + 1:part * w + w] AS x FROM kept, range(16) t(part))",
     "c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64)"]
    near = "{name} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, any_value(w) AS w, any_value(x) AS x, min(ROW(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]), entry)) AS best FROM p JOIN {book} USING (part) GROUP BY vec_id, part)"
    for k in range(rounds):
        steps.append(near.format(name=f"a{k}", book=f"c{k}"))
        steps.append(f"""s{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM
   (SELECT part, struct_extract(best, 2) AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, x, unnest(range(1, w + 1)) AS i FROM a{k}) GROUP BY ALL) GROUP BY part, entry)""")  # fmt: skip
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN s{k} USING (part, entry))")
    steps.append(near.format(name="z", book=f"c{rounds}"))
    steps.append("""v AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(struct_extract(best, 2) AS INT)), '' ORDER BY part) AS code, CAST(sum(struct_extract(best, 1)) AS BIGINT) AS error FROM z GROUP BY vec_id)""")
    book = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {book} AS codebooks_sha256 FROM v"


#: For distinct ids.
CODES = _codes_sql()

SQL = {"op3_chat": CHAT, "op7_mix": MIX, "op8_quality": QUALITY, "op12_fim": FIM, "op13_codes": CODES}
