"""DuckDB spellings of the folds, for checking: recursive tables instead of Python loops.

Each function gives a SELECT over a table or subquery ``src (id, text)``; names inside are local to it.
"""

from __future__ import annotations

from scrollweave.functions.text import BLANK
from scrollweave.operators.frames import C1, C2, LEAST_OVERLAP, OFFSETS, SCROLLED, blur_matrix

#: White space of Unicode in DuckDB's regular expressions.
WS = r"[\t-\r\x{85}\p{Z}]"


def d_lines(x: str) -> str:
    r = f"replace({x}, chr(13) || chr(10), chr(10))"
    return f"(CASE WHEN {r} = '' OR suffix({r}, chr(10)) THEN string_split({r}, chr(10))[1:len(string_split({r}, chr(10))) - 1] ELSE string_split({r}, chr(10)) END)"


def d_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def d_norm(x: str) -> str:
    lead = r"^[#*\->@+\t-\r\x{85}\p{Z}]+"
    trimmed = d_trim(f"replace(regexp_replace({x}, '{lead}', ''), '**', '')")
    return f"lower({trimmed})"


def d_hash(x: str) -> str:
    return f"md5({x})[1:12]"


def line_table(src: str) -> str:
    return f"L AS (SELECT id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT id, {d_lines('text')} AS a FROM {src}))"


#: Of a table L: F marks lines with content, B (id, block, i, line) numbers runs of them.
BLOCKS = f"""F AS (SELECT *, {d_trim('line')} <> '' AS solid FROM L),
S AS (SELECT *, sum(CASE WHEN solid AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) - 1 AS block FROM (SELECT *, lag(solid) OVER (PARTITION BY id ORDER BY i) AS before FROM F)),
B AS (SELECT id, block::BIGINT AS block, i::INT AS i, line FROM S WHERE solid)"""


def dedup_blocks(src: str) -> str:
    return f"""WITH RECURSIVE {line_table(src)}, {BLOCKS},
M AS (SELECT id, block, string_agg(line, chr(10) ORDER BY i) AS body, list_sort(list({d_hash(d_norm('line'))})) AS bag FROM B GROUP BY ALL),
K AS (SELECT id, bag, min(block) AS kind, len(bag) AS n FROM M GROUP BY ALL), H AS (SELECT id, kind, n, h, count(*) AS c FROM (SELECT id, kind, n, unnest(bag) AS h FROM K) GROUP BY ALL),
X AS (SELECT x.id, x.kind AS a, y.kind AS b, y.n > x.n AS longer FROM H x JOIN H y ON x.id = y.id AND x.h = y.h GROUP BY x.id, x.kind, y.kind, x.n, y.n HAVING sum(least(x.c, y.c)) / greatest(x.n, y.n)::DOUBLE > 0.85::DOUBLE),
O AS (SELECT M.id, M.block, K.kind FROM M JOIN K USING (id, bag)),
N AS (SELECT p.id, p.block, list({{'j': q.block, 'longer': X.longer}} ORDER BY q.block) AS near FROM O p JOIN X ON X.id = p.id AND X.a = p.kind JOIN O q ON q.id = p.id AND q.kind = X.b AND q.block > p.block GROUP BY ALL),
Z AS (SELECT id, max(block) + 1 AS blocks FROM M GROUP BY id),
G AS (SELECT id, -1::BIGINT AS i, []::BIGINT[] AS gone FROM Z UNION ALL
  SELECT id, i + 1, CASE WHEN list_contains(gone, i + 1) OR live IS NULL THEN gone
    WHEN stop IS NULL THEN list_concat(gone, list_transform(live, lambda x: x.j))
    ELSE list_concat(list_concat(gone, list_transform(list_filter(live, lambda x: x.j < stop), lambda x: x.j)), [i + 1]) END
  FROM (SELECT *, list_min(list_transform(list_filter(live, lambda x: x.longer), lambda x: x.j)) AS stop FROM (
    SELECT G.id, G.i, G.gone, list_filter(N.near, lambda x: NOT list_contains(G.gone, x.j)) AS live FROM G JOIN Z USING (id) LEFT JOIN N ON N.id = G.id AND N.block = G.i + 1 WHERE G.i + 1 < Z.blocks))),
E AS (SELECT G.id, gone FROM G JOIN Z ON Z.id = G.id AND G.i = Z.blocks - 1),
T AS (SELECT M.id, string_agg(body, chr(10) || chr(10) ORDER BY block) AS text FROM M JOIN E USING (id) WHERE NOT list_contains(gone, block) GROUP BY M.id)
SELECT s.id, CASE WHEN coalesce(blocks, 0) <= 1 THEN s.text ELSE T.text END AS text FROM {src} s LEFT JOIN Z USING (id) LEFT JOIN T USING (id)"""


def dedup_passages(src: str) -> str:
    return f"""WITH RECURSIVE {line_table(src)}, H AS (SELECT id, i, line, {d_hash(d_norm('line'))} AS h FROM L),
W AS (SELECT id, i, h, lead(h, 1) OVER w AS h1, lead(h, 2) OVER w AS h2 FROM H WINDOW w AS (PARTITION BY id ORDER BY i)),
C AS (SELECT id, i, s FROM (SELECT *, min(i) OVER (PARTITION BY id, h, h1, h2) AS s FROM W WHERE h2 IS NOT NULL) WHERE s <= i - 3 AND h <> '{BLANK}' AND len(list_distinct(list_filter([h, h1, h2], lambda x: x <> '{BLANK}'))) >= 2),
A AS (SELECT id, list(h ORDER BY i) AS hs, count(*) AS n FROM H GROUP BY id),
J AS (SELECT C.id, C.i, coalesce(list_position(list_transform(range(3, least(n - C.i, C.i - s)), lambda k: hs[C.i + k + 1] <> hs[s + k + 1]), true) + 2, least(n - C.i, C.i - s)) AS size FROM C JOIN A USING (id)),
Q AS (SELECT id, list({{'i': i, 'size': size}} ORDER BY i) AS hits FROM J GROUP BY id),
R AS (SELECT id, 3::BIGINT AS next, NULL::BIGINT AS i, NULL::BIGINT AS size FROM Q UNION ALL
  SELECT id, hit.i + hit.size, hit.i, hit.size FROM (SELECT id, list_filter(hits, lambda x: x.i >= R.next)[1] AS hit FROM R JOIN Q USING (id)) WHERE hit IS NOT NULL),
T AS (SELECT L.id, string_agg(line, chr(10) ORDER BY L.i) AS text FROM L WHERE NOT EXISTS (SELECT 1 FROM R WHERE R.id = L.id AND L.i >= R.i AND L.i < R.i + R.size) GROUP BY L.id)
SELECT s.id, CASE WHEN coalesce(n, 0) < 3 THEN s.text ELSE T.text END AS text FROM {src} s LEFT JOIN A USING (id) LEFT JOIN T USING (id)"""


def _overlap(p: str, h: str) -> str:
    """Of lists of hashes, as ``lines.overlap``."""
    tail = f"list_slice({p}, len({p}) - n + 1, len({p}))"
    exact = f"list_max(list_filter(range(3, least(len({p}), len({h})) + 1), lambda n: {tail} = {h}[1:n]))"
    near = f"len(list_filter(list_zip({tail}, {h}[1:n]), lambda z: z[1] = z[2])) >= n * 0.85::DOUBLE AND len(list_filter({tail}, lambda z: z <> '{BLANK}')) >= 3"
    fuzzy = f"list_max(list_filter(range(3, least(15, len({p}), len({h})) + 1), lambda n: {near}))"
    return f"coalesce({exact}, {fuzzy}, 0)"


def _reverse(full: str, h: str) -> str:
    """The first place, from 0, of the first ten hashes of ``h`` in ``full``; null if none or if they say too little."""
    w = f"least(len({h}), 10)"
    varied = f"len({h}) >= 3 AND len(list_distinct(list_filter({h}[1:{w}], lambda z: z <> '{BLANK}'))) >= 2"
    return f"(CASE WHEN {varied} THEN list_min(list_filter(range(len({full}) - {w} + 1), lambda j: {full}[j + 1 : j + {w}] = {h}[1:{w}])) END)"


def stitch_scroll(captures: str) -> str:
    """Over ``captures (id, k, v)`` with lists of lines, ``k`` from 0 without gaps."""
    return f"""WITH RECURSIVE V AS (SELECT id, k, v, list_transform(v, lambda x: {d_hash('x')}) AS h FROM {captures}),
R AS (SELECT id, k, v AS fl, h AS fh FROM V WHERE k = 0 UNION ALL
  SELECT id, k, CASE WHEN n > 0 THEN list_concat(fl, v[n + 1 :]) WHEN back IS NOT NULL THEN fl ELSE list_concat(fl, v) END,
    CASE WHEN n > 0 THEN list_concat(fh, h[n + 1 :]) WHEN back IS NOT NULL THEN fh ELSE list_concat(fh, h) END
  FROM (SELECT *, {_overlap('p', 'h')} AS n, {_reverse('fh', 'h')} AS back FROM (
    SELECT V.id, V.k, V.v, V.h, fl, fh, list_slice(fh, greatest(1, len(fh) - len(V.h) + 1), len(fh)) AS p FROM R JOIN V ON V.id = R.id AND V.k = R.k + 1)))
SELECT id, array_to_string(fl, chr(10)) AS text FROM R QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1"""


def stitch_revisions(captures: str) -> str:
    """Over ``captures (id, k, text)``, ``k`` from 1 without gaps."""
    return f"""WITH RECURSIVE V AS (SELECT id, k, {d_lines("coalesce(text, '')")} AS v FROM {captures}),
D AS (SELECT id, k, v, list_transform(v, lambda x: {d_hash(d_norm('x'))}) AS h, len(list_filter(v, lambda x: {d_trim('x')} <> '')) AS solid FROM V),
H AS (SELECT id, k, h, count(*) AS c FROM (SELECT id, k, unnest(h) AS h FROM D WHERE solid >= 3) GROUP BY ALL), Y AS (SELECT id, k, sum(c) AS n FROM H GROUP BY ALL),
X AS (SELECT x.id, y.k, list(DISTINCT x.k) AS before FROM (SELECT x.id, x.k, y.k AS l, sum(least(x.c, y.c)) AS common FROM H x JOIN H y ON x.id = y.id AND x.h = y.h AND x.k < y.k GROUP BY ALL) x
  JOIN Y p ON p.id = x.id AND p.k = x.k JOIN Y y ON y.id = x.id AND y.k = x.l WHERE common / greatest(p.n, y.n)::DOUBLE > 0.75::DOUBLE GROUP BY x.id, y.k),
R AS (SELECT id, 0::BIGINT AS k, []::VARCHAR[] AS fl, []::VARCHAR[] AS fh, []::BIGINT[] AS taken FROM (SELECT DISTINCT id FROM D) UNION ALL
  SELECT id, k, CASE WHEN skip THEN fl ELSE list_concat(fl, v[n + 1 :]) END, CASE WHEN skip THEN fh ELSE list_concat(fh, h[n + 1 :]) END, CASE WHEN skip THEN taken ELSE list_append(taken, k) END
  FROM (SELECT *, CASE WHEN skip OR len(fh) = 0 THEN 0 WHEN o > 0 THEN o WHEN back IS NOT NULL THEN
      coalesce(list_position(list_transform(range(least(len(h), len(fh) - back)), lambda q: fh[back + q + 1] <> h[q + 1]), true) - 1, least(len(h), len(fh) - back)) ELSE 0 END AS n FROM (
    SELECT *, CASE WHEN NOT skip AND len(p) > 0 THEN {_overlap('p', 'h')} ELSE 0 END AS o, CASE WHEN NOT skip AND len(fh) > 0 THEN {_reverse('fh', 'h')} END AS back FROM (
      SELECT D.id, D.k, D.v, D.h, fl, fh, taken, solid < 3 OR coalesce(list_has_any(taken, X.before), false) AS skip, list_slice(fh, greatest(1, len(fh) - 199), len(fh)) AS p
      FROM R JOIN D ON D.id = R.id AND D.k = R.k + 1 LEFT JOIN X ON X.id = D.id AND X.k = D.k))))
SELECT id, array_to_string(fl, chr(10)) AS text FROM R QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1"""


def sections(src: str) -> str:
    """CTEs from L to SEC (id, section, start, end, key, body_len)."""
    heading = f"(regexp_matches({d_trim('line')}, '^(#|@@)') OR regexp_matches({d_trim('line')}, '^[*\\->\\t-\\r\\x{{85}}\\p{{Z}}]*v[0-9]'))"
    return f"""{line_table(src)},
M AS (SELECT *, {heading} AS head, greatest(1, length(regexp_extract({d_trim('line')}, '^#+'))) AS level, {d_norm('line')} AS name FROM L),
N AS (SELECT *, sum(CASE WHEN head OR i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) - 1 AS section FROM M),
E AS (SELECT id, section, min(i) AS s, max(i) + 1 AS e, bool_or(head) AS head, max(CASE WHEN head THEN level END) AS level, max(CASE WHEN head THEN name END) AS name FROM N GROUP BY ALL),
A AS (SELECT x.id, x.section, y.section AS up, y.name, y.level, (SELECT min(z.level) FROM E z WHERE z.id = x.id AND z.head AND z.section > y.section AND z.section <= x.section) AS between_level
  FROM E x JOIN E y ON x.id = y.id AND y.head AND x.head AND y.section <= x.section),
K AS (SELECT id, section, string_agg(name, '|' ORDER BY up) AS key FROM A WHERE between_level IS NULL OR level < between_level GROUP BY ALL),
SEC AS (SELECT E.id, E.section::BIGINT AS section, s::BIGINT AS start, e::BIGINT AS "end", key, (e - s - CASE WHEN head THEN 1 ELSE 0 END)::BIGINT AS body_len FROM E LEFT JOIN K USING (id, section))"""


#: Of L and SEC: DS (id, i, line), the lines that stay.
DEDUP_SECTIONS = """SW AS (SELECT *, row_number() OVER (PARTITION BY id, coalesce(key, '#' || section) ORDER BY body_len DESC, section) AS rank, min(section) OVER (PARTITION BY id, coalesce(key, '#' || section)) AS place FROM SEC),
DS AS (SELECT L.id, row_number() OVER (PARTITION BY L.id ORDER BY place, L.i) - 1 AS i, L.line FROM SW JOIN L ON L.id = SW.id AND L.i >= SW.start AND L.i < SW."end" WHERE rank = 1)"""


def section_texts(src: str) -> str:
    return f"""WITH {sections(src)}, {DEDUP_SECTIONS}, T AS (SELECT id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\n+$', '') AS text FROM DS GROUP BY id), Z AS (SELECT id, count(*) AS n FROM SEC GROUP BY id)
SELECT s.id, CASE WHEN coalesce(n, 0) > 1 THEN T.text ELSE s.text END AS text FROM {src} s LEFT JOIN Z USING (id) LEFT JOIN T USING (id)"""


def _matrix(n: int) -> str:
    """The blur of ``n`` samples as a list of lists."""
    return "[" + ", ".join("[" + ", ".join(repr(float(k)) for k in row) + "]" for row in blur_matrix(n)) + "]::DOUBLE[][]"


def _rows(weights: str, rows: str) -> str:
    """Each of the lists ``rows`` times the matrix ``weights``."""
    return f"list_transform({rows}, lambda r: list_transform({weights}, lambda w: list_inner_product(w, r)))"


def _turned(rows: str, n: int) -> str:
    return f"list_transform(range(1, {n + 1}), lambda x: list_transform({rows}, lambda r: r[x]))"


def _ssim(a: str, b: str, aa: str, bb: str, ab: str) -> str:
    """Mean structural similarity by lists of blurred values, of both, their squares and their product."""
    one = f"(2 * {a}[i] * {b}[i] + {C1}::DOUBLE) * (2 * ({ab}[i] - {a}[i] * {b}[i]) + {C2}::DOUBLE) / (({a}[i] * {a}[i] + {b}[i] * {b}[i] + {C1}::DOUBLE) * ({aa}[i] - {a}[i] * {a}[i] + {bb}[i] - {b}[i] * {b}[i] + {C2}::DOUBLE))"
    return f"list_avg(list_transform(range(1, len({a}) + 1), lambda i: {one}))"


def _blurred(flat: str, n: int, m: str) -> str:
    """A flat ``n`` x ``n`` list, blurred by the matrix ``m`` both ways."""
    rows = f"list_transform(range({n}), lambda y: {flat}[y * {n} + 1 : y * {n} + {n}])"
    return f"flatten({_turned(_rows(m, _turned(_rows(m, rows), n)), n)})"


def frame_dedup(frames: str, n: int, threshold: float = 0.95) -> str:
    """``(video_id, seq)`` that stay of ``frames (video_id, seq, p)``, flat lists of ``n`` x ``n`` doubles."""
    product = "list_transform(list_zip(last, p), lambda z: z[1] * z[2])"
    return f"""WITH RECURSIVE F AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS k FROM {frames}),
G AS (SELECT *, {_blurred('p', n, 'm')} AS a, {_blurred('list_transform(p, lambda x: x * x)', n, 'm')} AS aa FROM F, (SELECT {_matrix(n)} AS m)),
R AS (SELECT video_id, k, seq, true AS kept, p AS last, a AS la, aa AS laa FROM G WHERE k = 1 UNION ALL
  SELECT video_id, k, seq, s < {threshold}::DOUBLE, CASE WHEN s < {threshold}::DOUBLE THEN p ELSE last END, CASE WHEN s < {threshold}::DOUBLE THEN a ELSE la END, CASE WHEN s < {threshold}::DOUBLE THEN aa ELSE laa END
  FROM (SELECT *, {_ssim('la', 'a', 'laa', 'aa', 'ab')} AS s FROM (SELECT G.video_id, G.k, G.seq, p, a, aa, last, la, laa, {_blurred(product, n, 'm')} AS ab FROM R JOIN G ON G.video_id = R.video_id AND G.k = R.k + 1)))
SELECT video_id, seq FROM R WHERE kept"""


def scroll_groups(frames: str, n: int) -> str:
    """``(video_id, seq, group_idx, seq_in_group)`` of ``frames (video_id, seq, p)``, flat lists of ``n`` x ``n`` doubles."""
    shifts = [s for s in (int(n * part) for part in OFFSETS) if n - s >= LEAST_OVERLAP]
    cases = ", ".join(f"({s}, {_matrix(n - s)})" for s in shifts)
    blur = lambda x: f"flatten({_rows('my', _turned(x, n))})"
    part = lambda x, low, high: f"{x}[{low} : {high}]"
    top, low = "n - s", "s + 1"
    return f"""WITH F AS (SELECT *, {n} AS n, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS k FROM {frames}), MX AS (SELECT {_matrix(n)} AS mx), MY(s, my) AS (VALUES {cases}),
B AS (SELECT video_id, seq, k, n, list_transform(range(n), lambda y: p[y * n + 1 : y * n + n]) AS rows FROM F),
H AS (SELECT *, {_rows('mx', 'rows')} AS a, {_rows('mx', 'list_transform(rows, lambda r: list_transform(r, lambda x: x * x))')} AS aa FROM B, MX),
P AS (SELECT y.video_id, y.seq, s, my, {part('x.a', low, 'y.n')} AS a, {part('x.aa', low, 'y.n')} AS aa, {part('y.a', 1, 'y.n - s')} AS b, {part('y.aa', 1, 'y.n - s')} AS bb,
  {_rows('y.mx', 'list_transform(range(1, y.n - s + 1), lambda j: list_transform(list_zip(x.rows[j + s], y.rows[j]), lambda z: z[1] * z[2]))')} AS ab FROM H x JOIN H y ON x.video_id = y.video_id AND y.k = x.k + 1, MY),
S AS (SELECT video_id, seq, bool_or({_ssim('a', 'b', 'aa', 'bb', 'ab')} > {SCROLLED}::DOUBLE) AS moved FROM (SELECT video_id, seq, {', '.join(f'{blur(c)} AS {c}' for c in ('a', 'aa', 'b', 'bb', 'ab'))} FROM P) GROUP BY ALL),
G AS (SELECT F.video_id, F.seq, sum(CASE WHEN coalesce(moved, false) THEN 0 ELSE 1 END) OVER (PARTITION BY F.video_id ORDER BY F.seq) - 1 AS group_idx FROM F LEFT JOIN S ON S.video_id = F.video_id AND S.seq = F.seq)
SELECT video_id, seq, group_idx::BIGINT AS group_idx, (row_number() OVER (PARTITION BY video_id, group_idx ORDER BY seq) - 1)::INT AS seq_in_group FROM G"""
