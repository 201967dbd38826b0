"""DuckDB SQL of the registered queries, put together from expressions and common table expressions. Written apart from the Spark side, to check it."""

from __future__ import annotations

from ..functions import notes, regions

V = "'0123456789A_BCDEFGHIJK_LMNOPQRSTU_VWXYZ'"
CODE = "'[A-Z]{3}U[0-9]{7}'"
CLEAN, EXTRA, SUSPICIOUS = r"'[A-Z]{3}U\s*[0-9]{7}'", r"'[A-Z]{4}U\s*[0-9]{7}'", r"'[A-Z0-9]{3}U\s*[A-Z0-9]{7}'"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def digit(c: str) -> str:
    return "((" + " + ".join(f"(strpos({V}, substr({c}, {i + 1}, 1)) - 1) * {1 << i}" for i in range(10)) + ") % 11 % 10)"


def valid(c: str) -> str:
    """For canonical strings."""
    return f"(regexp_full_match({c}, {CODE}) AND {digit(c)} = try_cast(substr({c}, 11, 1) AS INTEGER))"


def norm(t: str) -> str:
    return f"translate(upper(replace(coalesce({t}, ''), 'ß', 'ss')), '-_', '  ')"


def found(t: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({norm(t)}, {pattern}), lambda m_: regexp_replace(m_, '\\s+', '', 'g'))"


def uniq(x: str) -> str:
    return f"list_filter({x}, lambda u_, i_: list_position({x}, u_) = i_)"


def candidates(t: str) -> str:
    return uniq(f"list_filter({found(t, CLEAN)}, lambda c_: {valid('c_')})")


def invalid(t: str) -> str:
    return uniq(f"list_filter({found(t, CLEAN)}, lambda c_: NOT {valid('c_')})")


def drop_i(c: str) -> str:
    s = f"(substr({c}, 1, 1) || substr({c}, 3))"
    return f"(CASE WHEN length({c}) = 12 AND substr({c}, 2, 1) = 'I' AND {valid(s)} THEN {s} END)"


def repaired(t: str) -> str:
    return uniq(f"list_filter(list_transform({found(t, EXTRA)}, lambda c_: {drop_i('c_')}), lambda r_: r_ IS NOT NULL)")


def suspicious(t: str) -> str:
    return uniq(f"list_filter({found(t, SUSPICIOUS)}, lambda c_: NOT regexp_full_match(c_, {CODE}))")


def meant(c: str) -> str:
    return f"(substr({c}, 1, 4) || translate(substr({c}, 5), 'OILBSZ', '011852'))"


def guess_pairs(t: str) -> str:
    """raw->repaired strings."""
    return uniq(f"list_transform(list_filter({found(t, SUSPICIOUS)}, lambda c_: regexp_matches(c_, '^[A-Z]{{3}}U') AND {meant('c_')} <> c_ AND {valid(meant('c_'))}), lambda c_: c_ || '->' || {meant('c_')})")


def guesses(t: str) -> str:
    x = f"list_transform({guess_pairs(t)}, lambda p_: substr(p_, length(p_) - 10))"
    return uniq(x)


def guessed(t: str) -> str:
    return f"(CASE WHEN len({guesses(t)}) = 1 THEN {guesses(t)}[1] END)"


def repairs(c: str) -> str:
    tries = f"list_transform(range(0, 60), lambda n_: substr({c}, 1, (4 + n_ // 10)::INT) || (n_ % 10)::VARCHAR || substr({c}, (6 + n_ // 10)::INT))"
    return f"(CASE WHEN regexp_full_match({c}, {CODE}) THEN list_filter({tries}, lambda t_: t_ <> {c} AND {valid('t_')}) ELSE []::VARCHAR[] END)"


def joined(x: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({x}, {q(by)}), '')"


def listed(x: str) -> str:
    d = uniq(x)
    return f"(array_to_string({d}[1:8], ', ') || CASE WHEN len({d}) > 8 THEN ' 等 ' || len({d})::VARCHAR || ' 个' ELSE '' END)"


def humanised(r: str) -> str:
    general = " ".join(f"WHEN contains(lower({r}), {q(a)}) OR contains(lower({r}), {q(b)}) THEN {q(w)} || {r}" for (a, b), w in notes.GENERAL_REASONS)
    coded = " ".join(f"WHEN contains({r}, {q(a)}) THEN {q(w)}" for a, w in notes.CODED_REASONS)
    return f"(CASE WHEN coalesce({r}, '') = '' THEN '' {general} {coded} ELSE {r} END)"


def with_reason(n: str, r: str) -> str:
    h = humanised(r)
    return f"(CASE WHEN {h} = '' THEN {n} WHEN coalesce({n}, '') = '' THEN {h} WHEN contains({n}, {h}) THEN {n} ELSE {n} || '；' || {h} END)"


def suspicious_note(t: str) -> str:
    s, p = suspicious(t), guess_pairs(t)
    a = f"CASE WHEN len({s}) > 0 THEN '疑似候选: ' || {listed(s)} END"
    b = f"CASE WHEN len({p}) > 0 THEN '可能修正: ' || CASE WHEN len({p}) = 1 THEN {guesses(t)}[1] ELSE {listed(p)} END || '（未自动采用）' END"
    return f"nullif(concat_ws('；', {a}, {b}), '')"


def repair_note(c: str) -> str:
    r = repairs(c)
    return f"(CASE WHEN len({r}) = 1 THEN '疑似校验修正: ' || {c} || ' -> ' || {r}[1] || '（待人工确认）' WHEN len({r}) > 1 THEN '多个疑似校验修正候选（未自动采用）: ' || {listed(r)} END)"


def target(name: str, status: str, code: str, review: str) -> str:
    suffix = f"regexp_extract({name}, '.(\\.[^./]+)$', 1)"
    return f"(CASE WHEN {status} = '正确识别' AND coalesce({code}, '') <> '' THEN {code} || {suffix} WHEN {status} <> '正确识别' AND coalesce({review}, '') <> '' THEN {review} || '-待确认' || {suffix} ELSE {name} END)"


def code10(k: str) -> str:
    return f"(chr((65 + {k} % 26)::INT) || chr((65 + ({k} // 26) % 26)::INT) || chr((65 + ({k} // 676) % 26)::INT) || 'U' || lpad(({k} * 7919 % 1000000)::VARCHAR, 6, '0'))"


def coded(k: str, off: int = 0) -> str:
    return f"({code10(k)} || (({digit(code10(k))} + {off}) % 10)::VARCHAR)"


FILES = f"""
fx0 AS (SELECT *, o_orderkey - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS k FROM orders),
fx1 AS (SELECT o_orderkey AS file_id, o_orderkey AS file_ord, o_orderstatus AS batch_id, CASE WHEN o_orderstatus = 'F' THEN '.pdf' ELSE '.jpg' END AS suffix,
  {coded("k")} AS code, {coded("k", 1)} AS wrong FROM fx0),
fx2 AS (SELECT *, CASE file_id % 11 WHEN 0 THEN code || suffix WHEN 1 THEN wrong || suffix ELSE 'scan-' || (file_id % 7000)::VARCHAR || CASE WHEN file_id % 11 <= 4 THEN '-1' ELSE '' END || suffix END AS original_name FROM fx1),
files AS (SELECT *, batch_id || '/' || (file_id // 10)::VARCHAR || '/' || original_name AS relative_name FROM fx2)"""

OBS = f"""{FILES},
items AS (SELECT l_orderkey AS file_id, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
kinds AS (SELECT i.*, code, wrong, (i.file_id * 31 + n * 7) % 12 AS kind, (n - 1) % 8 + 1 AS place FROM items i JOIN files USING (file_id)),
obs AS (SELECT file_id, ((n - 1) // 8 + 1)::INTEGER AS page_no, n AS seq,
  ['full', 'priority', 'priority', 'priority', 'priority', 'grid', 'grid', 'grid'][place] AS stage,
  ['full', 'priority-left-middle', 'priority-left-upper', 'priority-full-middle', 'priority-left-lower-middle', 'cell-r1-c1', 'cell-r1-c2', 'cell-r1-c3'][place] AS region_name,
  CASE kind WHEN 0 THEN 'CNTR ' || code || ' 45G1' WHEN 1 THEN substr(code, 1, 4) || '  ' || substr(code, 5) WHEN 2 THEN wrong
    WHEN 3 THEN substr(code, 1, 4) || translate(substr(code, 5), '018', 'OIB') WHEN 4 THEN substr(code, 1, 1) || 'I' || substr(code, 2)
    WHEN 5 THEN 'near ' || {coded("(file_id + 1)")} WHEN 6 THEN 'no-' || lower(code) || '_x' WHEN 7 THEN 'GROSS ' || l_quantity::INT::VARCHAR || ' KG'
    WHEN 8 THEN code || ' ' || code WHEN 9 THEN wrong || ' ' || code WHEN 10 THEN '' END AS text FROM kinds)"""

RESULTS = f"""{FILES},
rs0 AS (SELECT batch_id, file_ord, relative_name, original_name,
  CASE WHEN file_id % 10 <= 5 THEN '正确识别' WHEN file_id % 10 <= 7 THEN '箱号错误' ELSE '未识别' END AS status,
  CASE WHEN file_id % 10 <= 5 OR file_id % 10 = 7 THEN code WHEN file_id % 10 = 6 THEN wrong END AS container_code,
  CASE WHEN file_id % 10 <= 7 THEN 'OCR' END AS source,
  CASE file_id % 10 WHEN 6 THEN 'INVALID_CHECK_DIGIT' WHEN 7 THEN 'CONFLICTING_CANDIDATES' WHEN 8 THEN 'NO_CONTAINER_CANDIDATE' WHEN 9 THEN 'PROCESS_FAILED: Permission denied' END AS failure_reason,
  CASE WHEN file_id % 10 = 7 THEN '候选冲突，需人工复核: ' || code END AS review_note,
  CASE WHEN file_id % 10 IN (7, 9) THEN code END AS review_code,
  'X ' || substr(code, 1, 4) || translate(substr(code, 5), '018', 'OIB') AS ocr_text,
  (file_id * 37 % 5000)::INTEGER AS elapsed_ms FROM files),
results AS (SELECT *, CASE WHEN file_ord % 4 = 0 THEN status || '/' || {target("original_name", "status", "container_code", "review_code")} END AS output_relative_path FROM rs0)"""

ENTRIES = f"""
entries AS (SELECT file_id AS entry_pos, CASE WHEN file_id % 3 = 0 THEN code || ' 45G1' WHEN file_id % 30 = 1 THEN '  ' || lower({coded("(file_id - 1)")})
  WHEN file_id % 30 = 2 THEN 'invalid-line-' || file_id::VARCHAR WHEN file_id % 30 = 5 THEN wrong END AS entry FROM files),
en1 AS (SELECT entry_pos, trim(entry) AS entry, {candidates("trim(entry)")} AS codes FROM entries WHERE entry IS NOT NULL AND trim(entry) <> ''),
en2 AS (SELECT entry_pos, unnest(codes) AS code, unnest(range(len(codes))) AS nth_ FROM en1),
en3 AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY entry_pos, nth_) AS nth FROM en2),
inspected AS (SELECT 'valid' AS kind, entry_pos * 1000 + nth_ AS pos, code AS value FROM en3 WHERE nth = 1
  UNION ALL SELECT 'duplicate', entry_pos * 1000 + nth_, code FROM en3 WHERE nth = 2
  UNION ALL SELECT 'invalid', entry_pos * 1000, entry FROM en1 WHERE len(codes) = 0),
expected AS (SELECT pos, value AS code FROM inspected WHERE kind = 'valid')"""


ENHANCED = f"""
src(so, source) AS (VALUES (1, '400dpi'), (2, 'base')), bx(bo, box_name) AS (VALUES (1, 'full-middle'), (2, 'left-middle'), (3, 'left-lower-middle')), va(vo, variant) AS (VALUES (1, 'plain'), (2, 'x2sharp'), (3, 'x2binary')), ps(psm) AS (VALUES (6), (11)),
eo0 AS (SELECT *, (so - 1) * 9 + (bo - 1) * 3 + vo - 1 AS ix, substr(code, 1, 4) || 'X' || substr(code, 6) AS broken FROM files CROSS JOIN src CROSS JOIN bx CROSS JOIN va CROSS JOIN ps
  WHERE (source = 'base' OR suffix = '.pdf') AND (variant <> 'x2binary' OR suffix <> '.pdf' OR source = '400dpi')),
obs AS (SELECT file_id, 1 AS page_no, (100 + ix * 3 + CASE WHEN psm = 6 THEN 0 ELSE 1 END)::INTEGER AS seq, 'enhanced-' || source || '-' || box_name || '-' || variant AS region_name, source, box_name, variant,
  CASE file_id % 3 WHEN 1 THEN CASE WHEN source = '400dpi' AND bo = 1 THEN code || ' 45G1' ELSE broken END WHEN 2 THEN CASE WHEN bo <= 2 THEN code || ' 45G1' ELSE 'NOISE' END
  ELSE CASE (file_id * 5 + ix * 3 + psm) % 9 WHEN 3 THEN wrong WHEN 4 THEN substr(code, 1, 6) || 'X' || substr(code, 8) WHEN 5 THEN {coded("(file_id + 5)")} WHEN 6 THEN substr(code, 1, 4) || 'Q' || substr(code, 6)
    WHEN 7 THEN 'NOISE' WHEN 8 THEN 'NOISE' ELSE code || ' 45G1' END END AS text FROM eo0),
cf0 AS (SELECT file_id, code, substr(code, 1, 4) || lpad(((file_id * 7919 + 3) % 1000000)::VARCHAR, 6, '0') AS ten FROM files),
confirmed AS (SELECT file_id, 1 AS page_no, CASE file_id % 4 WHEN 0 THEN code WHEN 1 THEN ten || {digit("ten")}::VARCHAR WHEN 2 THEN {coded("(file_id + 5)")} END AS confirmation FROM cf0)"""


def scored(rep: bool) -> str:
    p = EXTRA if rep else CLEAN
    return f"""
m{int(rep)}a AS (SELECT file_id, page_no, seq, region_name, {norm("text")} AS n, regexp_extract_all({norm("text")}, {p}) AS m, string_split_regex({norm("text")}, {p}) AS pc FROM obs),
m{int(rep)}b AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{int(rep)}a),
m{int(rep)}c AS (SELECT file_id, page_no, seq, region_name, n, i, m[i] AS raw0, regexp_replace(m[i], '\\s+', '', 'g') AS raw,
  (list_sum(list_transform(pc[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::INTEGER AS start FROM m{int(rep)}b),
m{int(rep)}d AS (SELECT *, {drop_i("raw") if rep else f"CASE WHEN {valid('raw')} THEN raw END"} AS code, start + length(raw0) AS stop FROM m{int(rep)}c),
m{int(rep)} AS (SELECT file_id, page_no, seq, i, code, raw, start, stop, {str(rep).lower()} AS is_repaired,
  {70 if rep else 100} + CASE WHEN region_name <> 'full' THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(substr(n, greatest(0, start - 24) + 1, stop + 24 - greatest(0, start - 24)), '[0-9]{{2}}[A-Z][0-9]') THEN 40 ELSE 0 END
  + CASE WHEN regexp_matches(substr(n, greatest(0, start - 24) + 1, stop + 24 - greatest(0, start - 24)), 'CONTAINER|CNTR|CTNR|CONT|箱号|柜号') THEN 25 ELSE 0 END AS score
  FROM m{int(rep)}d WHERE code IS NOT NULL)"""


MATCHES = f"""{OBS}, {scored(False)}, {scored(True)}, matches AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1)"""


EMATCHES = f"""{FILES}, {ENHANCED}, {scored(False)}, {scored(True)}, matches AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1)"""


def ranking(keys: str, source: str = "matches", tag: str = "") -> str:
    """CTEs rank{tag} and best{tag}."""
    return f"""
rk{tag} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, is_repaired, code ORDER BY seq, i) AS a, count(*) OVER (PARTITION BY {keys}, is_repaired, code) AS b FROM {source}),
rank{tag} AS (SELECT {keys}, is_repaired, code, max(score + 5 * (b - a + CASE WHEN a = 1 THEN 0 ELSE 1 END))::INTEGER AS score, min_by(raw, a) AS raw, min(seq * 1000 + i) AS ord FROM rk{tag} GROUP BY {keys}, is_repaired, code),
best{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY is_repaired, score DESC, ord) AS place FROM rank{tag}) WHERE place = 1)"""


def conflict(keys: str, obs: str, tag: str = "", region: str = "region_name") -> str:
    """CTE judged{tag}: keys, code, n_regions, competing, repeated, strong for the codes of best{tag}."""
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))
    xs = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""
sup{tag} AS (SELECT {keys}, code, count(DISTINCT {region})::INTEGER AS n FROM (SELECT {keys}, {region}, unnest({candidates("text")}) AS code FROM {obs}) GROUP BY {keys}, code),
sus{tag} AS (SELECT {keys}, code, count(DISTINCT {region})::INTEGER AS n FROM (SELECT {keys}, {region}, unnest({suspicious("text")}) AS code FROM {obs}) GROUP BY {keys}, code),
own{tag} AS (SELECT {xs}, x.code, x.score, x.is_repaired, x.raw, coalesce(max(y.n) FILTER (y.code = x.code), 0) AS n, coalesce(max(s.score) FILTER (s.code = x.code), 0) AS own_score
  FROM best{tag} x LEFT JOIN sup{tag} y ON {on} LEFT JOIN rank{tag} s ON {on.replace("y.", "s.")} AND NOT s.is_repaired GROUP BY ALL),
com{tag} AS (SELECT {xs}, list_sort(list(DISTINCT y.code)) AS competing, bool_or(y.n >= 2 OR x.n <= 1 OR coalesce(s.score, 0) >= x.own_score) AS hard
  FROM own{tag} x JOIN sup{tag} y ON {on} AND y.code <> x.code LEFT JOIN rank{tag} s ON {on.replace("y.", "s.")} AND NOT s.is_repaired AND s.code = y.code GROUP BY {xs}),
odd{tag} AS (SELECT {xs}, list_sort(list(DISTINCT y.code) FILTER (y.n >= 2)) AS repeated FROM own{tag} x JOIN sus{tag} y ON {on} AND y.code <> x.code AND substr(y.code, 1, 4) = substr(x.code, 1, 4) GROUP BY {xs}),
judged{tag} AS (SELECT {xs}, x.code, x.score, x.is_repaired, x.raw, x.n AS n_regions, {joined("y.competing")} AS competing, {joined("z.repeated")} AS repeated,
  coalesce(y.hard, false) OR len(coalesce(z.repeated, [])) > 0 OR (x.n <= 1 AND z.file_id IS NOT NULL) AS strong
  FROM own{tag} x LEFT JOIN com{tag} y ON {on} LEFT JOIN odd{tag} z ON {on.replace("y.", "z.")})"""


PAGE = "file_id, page_no"
PREFIXES = f"""
pre AS (SELECT o.*, e.seq AS upto FROM obs o JOIN obs e ON o.file_id = e.file_id AND o.page_no = e.page_no AND o.seq <= e.seq),
prematches AS (SELECT m.*, e.seq AS upto FROM matches m JOIN obs e ON m.file_id = e.file_id AND m.page_no = e.page_no AND m.seq <= e.seq),
{ranking("file_id, page_no, upto", "prematches", "p")}, {conflict("file_id, page_no, upto", "pre", "p")}"""


def boxes() -> str:
    rows = [(n, *(10 * x for x in b)) for n, *b in regions.PRIORITY]
    for r in range(8):
        for c in range(3):
            rows.append((f"cell-r{r + 1}-c{c + 1}", max(0, c * 1000 // 3 - 40), max(0, r * 125 - 40), min(1000, (c + 1) * 1000 // 3 + 40), min(1000, (r + 1) * 125 + 40)))
    return "boxes(region_name, l, t, r, b) AS (VALUES " + ", ".join(f"({q(n)}, {a}, {b}, {c}, {d})" for n, a, b, c, d in rows) + ")"
