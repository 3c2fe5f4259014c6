"""DuckDB SQL for the registered queries, written from the semantics and not from the Spark plans.

Shared inputs are common table expressions over `orders`; pattern conditions are spelled out
over one column a match (m0, m1, ...) of each read.
"""

from __future__ import annotations

import re

from . import kits
from .queries import BEFORE, FILTERS, MULTI, PAIR, SINGLE

HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
COMPLEMENT = "'ACGTRYKMBDHVacgtrykmbdhv', 'TGCAYRMKVHDBtgcayrmkvhdb'"


def _dna(key: str, salt: str) -> str:
    return f"translate(md5({key} || '{salt}'), {HEX})"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows) + ")"


_RAPID = kits.label_range("RBK01", "RBK96")
_LEFT, _RIGHT = kits.FLANKS["RBK4"]
_BARS = _values([(i, x, kits.barcode(x)) for i, x in enumerate(_RAPID)])

READS = f"""
    bars(i, label, bar) AS {_BARS},
    base AS (SELECT o_orderkey AS k, {' || '.join(_dna('o_orderkey', chr(97 + i)) for i in range(20))} AS body FROM orders),
    parts AS (
        SELECT k, body, a.label, '{_LEFT}' || a.bar || '{_RIGHT}' AS one, '{_LEFT}' || b.bar || '{_RIGHT}' AS two
        FROM base JOIN bars a ON a.i = k % 96 JOIN bars b ON b.i = (k * 7 + 5) % 96
    ), planted AS (
        SELECT k, (k % 6)::INTEGER AS scenario, CASE WHEN k % 6 > 0 THEN label END AS label,
               CASE k % 6 WHEN 0 THEN body WHEN 1 THEN one || body WHEN 2 THEN one[11:] || body WHEN 3 THEN one || body[1:10] || two || body
                          WHEN 4 THEN one || body[1:320] || two || body[321:] ELSE one || body || reverse(translate(two, {COMPLEMENT})) END AS seq
        FROM parts
    )"""

LISTS = """
    spread AS (SELECT o_orderkey AS k, 1000 + o_orderkey % 997 AS n, unnest(generate_series(0, o_orderkey % 4)) AS i FROM orders),
    placed AS (
        SELECT *, CASE i WHEN 0 THEN k * 7 % 300
                         WHEN 1 THEN CASE k % 3 WHEN 0 THEN k * 7 % 300 + 60 + k * 13 % 220 WHEN 1 THEN n - 40 - k * 11 % 280 ELSE 500 END
                         WHEN 2 THEN n - 40 - k * 5 % 260 ELSE n - 38 END AS s,
               CASE WHEN i = 0 AND k % 11 = 0 THEN 'Fflank' WHEN i = 0 AND k % 11 = 1 THEN 'Rtag' WHEN i > 0 AND (k + i) % 9 = 0 THEN 'Fflank' ELSE 'Ftag' END AS match_type,
               CASE WHEN i = 0 THEN CASE WHEN k % 13 = 0 THEN 'Rc' ELSE 'Fwd' END WHEN (k + i) % 2 = 0 THEN 'Rc' ELSE 'Fwd' END AS strand
        FROM spread
    ), lists AS (
        SELECT 'r' || k AS read_id, k, i::INTEGER AS anno_idx, n::INTEGER AS read_len, s::INTEGER AS read_start_bar, (s + 24)::INTEGER AS read_end_bar,
               greatest(0, s - 16)::INTEGER AS read_start_flank, least(n, s + 74)::INTEGER AS read_end_flank, match_type, strand,
               CASE WHEN match_type = 'Fflank' THEN 'flank' ELSE 'BC0' || ((k + i * (k % 2)) % 3 + 1) END AS label,
               ((k + i) % 7)::INTEGER AS flank_cost, ((k * 3 + i) % 5)::INTEGER AS barcode_cost
        FROM placed
    ), dist AS (
        SELECT *, CASE WHEN read_start_flank = 0 THEN 1 WHEN read_start_flank <= read_len // 2 THEN read_start_flank
                       WHEN read_start_flank = read_len THEN -1 ELSE read_start_flank - read_len END::INTEGER AS rel_dist_to_end FROM lists
    )"""

#: matches of a read side by side
SIDE = """
    side AS (
        SELECT k, read_id, count(*) AS size, max(read_len) AS n, """ + ", ".join(f"any_value(l) FILTER (anno_idx = {i}) AS m{i}" for i in range(4)) + """
        FROM lists l GROUP BY k, read_id
    )"""

SEQS = f"""
    seqs AS (SELECT o_orderkey AS k, repeat({_dna('o_orderkey', 'a')}, 63)[1 : 1000 + o_orderkey % 997] AS seq,
                    repeat(translate(md5(o_orderkey || 'q'), '0123456789abcdef', '56789:;<=>?@ABCD'), 64)[1 : 1000 + o_orderkey % 997] AS qual FROM orders)"""


def _condition(pattern: str) -> tuple[str, int, list[tuple[int, str]]]:
    """SQL condition of a pattern over m0, m1, ..., its length, and (match, cut text) of its cuts."""
    tests, cuts, bound = [], [], {}
    elements = pattern.split("__")
    for i, element in enumerate(elements):
        kind, inner = re.match(r"(\w+)\[(.*)\]", element).groups()
        tests.append(f"m{i}.match_type = '{kind}'")
        for p in map(str.strip, inner.split(",")):
            number = re.findall(r"-?\d+", p)
            if p in ("fw", "rc"):
                tests.append(f"m{i}.strand = '{'Fwd' if p == 'fw' else 'Rc'}'")
            elif p.startswith("@left"):
                tests.append(f"m{i}.read_start_bar BETWEEN {number[0]} AND {number[1]}")
            elif p.startswith("@right"):
                tests.append(f"n - m{i}.read_end_bar BETWEEN {number[0]} AND {number[1]}")
            elif p.startswith("@prev") and i:
                tests.append(f"m{i}.read_start_bar - m{i - 1}.read_end_bar BETWEEN {number[0]} AND {number[1]}")
            elif p[0] == "?":
                if p in bound:
                    tests.append(f"m{i}.label = m{bound[p]}.label")
                bound.setdefault(p, i)
            elif p[:2] in (">>", "<<"):
                cuts.append((i, f"{'After' if p[0] == '>' else 'Before'}({p[2:] or 0}):{i}"))
            elif p[0] == "~":
                tests.append(f"contains(m{i}.label, '{p[1:]}')")
            elif p != "*" and kind.endswith("tag"):
                tests.append(f"m{i}.label = '{p}'")
    return f"size >= {len(elements)} AND " + " AND ".join(tests), len(elements), cuts


def _picked(patterns: list[str]) -> str:
    """CTE picked: the read's longest matching pattern, the first among equals."""
    found = [_condition(p) for p in patterns]
    order = sorted(range(len(found)), key=lambda i: (-found[i][1], i))
    which = "CASE " + " ".join(f"WHEN {found[i][0]} THEN {i}" for i in order) + " END"
    return f"picked AS (SELECT *, {which} AS pick FROM side)"


def _filtered(patterns: list[str]) -> str:
    found = [_condition(p) for p in patterns]
    kept = "coalesce(CASE pick " + " ".join(f"WHEN {i} THEN size = {f[1]}" for i, f in enumerate(found)) + " END, false)"
    text = {(p, i): ",".join(t for j, t in f[2] if j == i) for p, f in enumerate(found) for i in {j for j, _ in f[2]}}
    cuts = "CASE " + " ".join(f"WHEN pick = {p} AND anno_idx = {i} THEN '{t}'" for (p, i), t in text.items()) + " ELSE '' END"
    return f"WITH {LISTS}, {SIDE}, {_picked(patterns)}, filtered AS (SELECT l.*, size, pick, {kept} AS kept, {cuts} AS cuts FROM lists l JOIN picked USING (read_id))"


def _filter(patterns: list[str]) -> str:
    return _filtered(patterns) + " SELECT read_id, anno_idx, kept, cuts FROM filtered"


def _slice(patterns: list[str], rows: str, flip: bool = False, whole: bool = False) -> str:
    """rows: SELECT of k, read_id, nth, lo, hi, label, turn from kept reads."""
    lo, hi = ("0", "length(seq)") if whole else ("lo", "hi")
    turn = "turn" if flip else "false"
    return _filtered(patterns) + f""", {SEQS}, kept AS (SELECT * FROM picked),
        cut AS ({rows}),
        pieces AS (SELECT read_id || CASE WHEN nth = 0 THEN '' ELSE '_' || nth END AS id, label, {turn} AS turn, seq[{lo} + 1 : {hi}] AS s, qual[{lo} + 1 : {hi}] AS q FROM cut JOIN seqs USING (k) WHERE lo < hi)
        SELECT id, label, length(s)::INTEGER AS bases, md5(CASE WHEN turn THEN reverse(translate(s, {COMPLEMENT})) ELSE s END) AS seq_md5, md5(CASE WHEN turn THEN reverse(q) ELSE q END) AS qual_md5 FROM pieces"""


def _tag(m: str) -> str:
    return f"{m}.label || CASE WHEN {m}.strand = 'Fwd' THEN '_fw' ELSE '_rc' END"


def _turn(*ms: str) -> str:
    return "(" + " OR ".join(f"({m}.match_type = 'Ftag' AND {m}.strand = 'Rc')" for m in ms) + ")"


_PAIR_ROWS = f"SELECT k, read_id, 0 AS nth, m0.read_end_flank AS lo, m1.read_start_flank AS hi, {_tag('m0')} || '__' || {_tag('m1')} AS label, {_turn('m0', 'm1')} AS turn FROM kept WHERE pick = 0 AND size = 2"
_MULTI_ROWS = (
    f"SELECT k, read_id, 0 AS nth, m0.read_end_flank AS lo, m1.read_start_flank AS hi, {_tag('m0')} || '__' || {_tag('m1')} AS label, false AS turn, m0.read_start_flank AS a, m1.read_start_flank AS b FROM kept WHERE pick = 0 AND size = 3 "
    f"UNION ALL SELECT k, read_id, 1, m1.read_end_flank, m2.read_start_flank, {_tag('m1')} || '__' || {_tag('m2')}, false, m0.read_start_flank, m1.read_start_flank FROM kept WHERE pick = 0 AND size = 3"
)
# groups are taken in order of their first start: the second group may come first
_MULTI_ORDERED = f"SELECT k, read_id, CASE WHEN b < a THEN 1 - nth ELSE nth END AS nth, lo, hi, label, turn FROM ({_MULTI_ROWS})"

_BUCKET = "(greatest({0} - 1, 0) // {1} * {1})"


def _structure(size: int) -> str:
    def b(x):
        return _BUCKET.format(x, size)

    to_right = "greatest(read_len - read_end_bar, 0)"
    gap = "greatest(read_start_bar - before, 0)"
    right = f"'@right(' || {b(to_right)} || '..' || ({b('greatest(read_len - read_start_bar, 0)')} + {size}) || ')'"
    return f"""WITH {LISTS}, seen AS (SELECT *, lag(read_end_bar) OVER (PARTITION BY read_id ORDER BY anno_idx) AS before FROM dist),
        texts AS (
            SELECT read_id, anno_idx, match_type || '[' || CASE strand WHEN 'Fwd' THEN 'fw' ELSE 'rc' END || ', *, ' ||
                   CASE WHEN before IS NOT NULL AND {gap} <= {to_right} THEN '@prev_left(' || {b(gap)} || '..' || ({b(gap)} + {size}) || ')'
                        WHEN before IS NULL AND rel_dist_to_end > 0 THEN '@left(' || {b('read_start_bar')} || '..' || ({b('read_start_bar')} + {size}) || ')'
                        ELSE {right} END || ']' AS element
            FROM seen
        ), patterns AS (SELECT read_id, string_agg(element, '__' ORDER BY anno_idx) AS pattern FROM texts GROUP BY read_id)"""


def _collapse_pairs(num: int, den: int) -> str:
    """At most four matches a read: the open group's first member is followed step by step."""
    def linked(a: int, b: int) -> str:
        x, y = f"o{a}", f"o{b}"
        shared = f"(least({x}.read_end_flank, {y}.read_end_flank) - greatest({x}.read_start_flank, {y}.read_start_flank))"
        span = f"least({x}.read_end_flank - {x}.read_start_flank, {y}.read_end_flank - {y}.read_start_flank)"
        return f"coalesce({shared} > 0 AND {shared} * {den} >= {num} * {span}, false)"

    steps, names = [], ["o0", "o1", "o2", "o3"]
    prior = "side_by_start"
    for b in range(1, 4):
        # f{b}: index of the first member of the group that match b is in
        before = "0" if b == 1 else f"f{b - 1}"
        joins = " OR ".join(f"({before} <= {a} AND {linked(a, b)})" for a in range(b))
        steps.append(f"s{b} AS (SELECT *, CASE WHEN {joins} THEN {before} ELSE {b} END AS f{b} FROM {prior})")
        prior = f"s{b}"
    return f"""WITH {LISTS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY read_start_flank, anno_idx) - 1 AS r FROM lists),
        side_by_start AS (SELECT read_id, {', '.join(f'any_value(o) FILTER (r = {i}) AS {n}' for i, n in enumerate(names))} FROM ordered o GROUP BY read_id),
        {', '.join(steps)},
        grouped AS (
            SELECT o.*, CASE r WHEN 0 THEN 0 WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS f FROM ordered o JOIN s3 USING (read_id)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY read_id, f ORDER BY match_type LIKE '%tag' DESC,
                       CASE WHEN match_type LIKE '%tag' THEN barcode_cost ELSE read_start_flank - read_end_flank END,
                       CASE WHEN match_type LIKE '%tag' THEN flank_cost ELSE 0 END, r) AS best
            FROM grouped
        )
        SELECT read_id, (row_number() OVER (PARTITION BY read_id ORDER BY f) - 1)::INTEGER AS anno_idx, read_start_flank, read_end_flank, match_type, label, barcode_cost, flank_cost
        FROM ranked WHERE best = 1"""


def _edit_distance(pattern: str, length: int) -> str:
    """Least cost of the pattern anywhere in seq: one row a text position, one column a pattern position."""
    m = len(pattern)
    cells, prev = [], "0"
    for i, c in enumerate(pattern):
        up = f"d{i - 1}" if i else "0"
        cells.append(f"least({up} + CASE WHEN c = '{c}' THEN 0 ELSE 1 END, d{i} + 1, {prev} + 1) AS e{i}")
        prev = f"e{i}"
    first = ", ".join(f"{i + 1} AS d{i}" for i in range(m))
    return f"""WITH RECURSIVE texts AS (SELECT o_orderkey, {_dna('o_orderkey', 'a')} || {_dna('o_orderkey', 'b')} AS seq FROM orders),
        dp AS (
            SELECT o_orderkey, seq, 0 AS j, {first} FROM texts
            UNION ALL
            SELECT o_orderkey, seq, j + 1, {', '.join(f'e{i}' for i in range(m))}
            FROM (SELECT *, {', '.join(cells)} FROM (SELECT *, seq[j + 1] AS c FROM dp WHERE j < {length}))
        ) SELECT o_orderkey, min(d{m - 1})::INTEGER AS cost FROM dp GROUP BY o_orderkey"""


def _label_variants() -> str:
    out = []
    for i in range(48):
        named, oriented, flanks, ordered = (i >> b & 1 == 0 for b in range(4))
        side = (None, "left", "right")[i // 16]
        if ordered and side:
            continue
        name = "".join("01"[v] for v in (named, oriented, flanks, ordered)) + (side or "none")
        part = "m.label" + (" || CASE m.strand WHEN 'Fwd' THEN '_fw' ELSE '_rc' END" if oriented else "")
        order = f"({part})" if ordered else "m.anno_idx"
        which = "string_agg" if not side else ("arg_min" if side == "left" else "arg_max")
        value = f"string_agg({part}, '__' ORDER BY {order})" if not side else f"{which}({part}, m.anno_idx)"
        keep = "" if flanks else " FILTER (NOT contains(m.label, 'flank'))"
        out.append(f"SELECT read_id, '{name}' AS variant, " + (f"coalesce({value}{keep}, 'none')" if named else "'none'") + " AS label FROM filtered m WHERE kept GROUP BY read_id")
    return _filtered(PAIR) + " " + " UNION ALL ".join(out)


def _spans() -> str:
    """Label ranges spelled out: span, numbers, prefix rules."""
    def rows(span, lo, hi, expr):
        return f"SELECT '{span}' AS span, (n - {lo})::INTEGER AS position, {expr} AS label FROM (SELECT unnest(generate_series({lo}, {hi})) AS n)"

    two = "lpad(n::VARCHAR, 2, '0')"
    special = ", ".join(map(str, kits.RBK))
    return " UNION ALL ".join([
        rows("BC01-BC12", 1, 12, f"'BC' || {two}"),
        rows("BC01-BC12+12A", 1, 12, f"'BC' || {two} || CASE WHEN n = 12 THEN 'A' ELSE '' END"),
        rows("NB13-NB24", 13, 24, f"'NB' || {two}"),
        rows("RBK24-RBK61", 24, 61, f"CASE WHEN n IN ({special}) THEN 'RBK' ELSE 'BC' END || {two}"),
        rows("AB01-AB24", 1, 24, f"'AB' || {two}"),
        rows("BC1A-BC13A", 1, 13, f"'BC' || {two} || CASE WHEN n = 12 THEN 'A' ELSE '' END"),
        rows("BC12-BC01", 1, 12, f"'BC' || {two}"),
    ])


def _catalog_expand() -> str:
    template = _values([(f, i, t.kind, t.flanks, *kits.FLANKS[t.flanks], re.sub(r"\d", "", t.first), int(re.sub(r"\D", "", t.first)), int(re.sub(r"\D", "", t.last)), t.use_12a, t.extended) for f, (ts, _) in kits.FAMILIES.items() for i, t in enumerate(ts)])
    bc = _values([(i + 1, s) for i, s in enumerate(kits.BC)])
    ab = _values([(i + 1, s) for i, s in enumerate(kits.AB)])
    rbk = _values(list(kits.RBK.items()))
    return f"""WITH template(family, template, kind, flanks, a, b, prefix, lo, hi, use_12a, extended) AS {template},
        bc(n, s) AS {bc}, ab(n, s) AS {ab}, rbk(n, s) AS {rbk},
        spread AS (SELECT *, unnest(generate_series(lo, hi)) AS n FROM template)
        SELECT family, template, kind, extended,
               CASE WHEN prefix = 'RBK' AND rbk.s IS NULL THEN 'BC' ELSE prefix END || lpad(t.n::VARCHAR, 2, '0') || CASE WHEN t.n = 12 AND use_12a THEN 'A' ELSE '' END AS label,
               a || CASE WHEN t.n = 12 AND use_12a THEN '{kits.BC12A}' WHEN prefix = 'AB' THEN ab.s WHEN prefix = 'RBK' AND rbk.s IS NOT NULL THEN rbk.s
                         WHEN prefix = 'NB' AND t.n <= 12 THEN reverse(translate(bc.s, {COMPLEMENT})) ELSE bc.s END || b AS seq
        FROM spread t JOIN bc ON bc.n = t.n LEFT JOIN ab ON ab.n = t.n LEFT JOIN rbk ON rbk.n = t.n"""


def _group_flanks() -> str:
    """Flanks by counting equal prefixes and suffixes of the expanded queries of each kit."""
    queries = _values([(k, t, kind, label, seq) for k in kits.KITS for t, kind, label, seq in kits.expanded(k, True)])
    return f"""WITH q(kit, template, kind, label, seq) AS {queries},
        sized AS (SELECT kit, template, any_value(kind) AS kind, count(*) AS queries, any_value(length(seq)) AS n, any_value(seq) AS one FROM q GROUP BY kit, template),
        lens AS (SELECT kit, template, unnest(generate_series(1, n)) AS p FROM sized),
        pre AS (SELECT kit, template, max(p) AS pre FROM (SELECT kit, template, p FROM lens JOIN q USING (kit, template) GROUP BY ALL HAVING count(DISTINCT q.seq[1:p]) = 1) GROUP BY ALL),
        suf AS (SELECT kit, template, max(p) AS suf FROM (SELECT kit, template, p FROM lens JOIN q USING (kit, template) GROUP BY ALL HAVING count(DISTINCT right(q.seq, p)) = 1) GROUP BY ALL),
        g AS (SELECT *, n - pre - suf AS mask FROM sized JOIN pre USING (kit, template) JOIN suf USING (kit, template))
        SELECT kit, template, kind, one[1:pre] AS prefix, right(one, suf) AS suffix, pre::INTEGER AS bar_start, (pre + mask - 1)::INTEGER AS bar_last, greatest(0, pre - 10)::INTEGER AS pad_start,
               (pre + mask + 10)::INTEGER AS pad_end, queries::INTEGER AS queries, (least(n, pre + mask + 10) - greatest(0, pre - 10))::INTEGER AS padded_len,
               greatest(0, ceil(0.51 * (pre + suf) - 1.7312 * sqrt(pre + suf)))::INTEGER AS cutoff FROM g"""


def _planted(kept: str) -> str:
    """What follows the last adapter at the left of all planted reads of the scenarios that are kept."""
    return f"""WITH {READS} SELECT 'read' || k AS id, CASE scenario WHEN 3 THEN c.label ELSE planted.label END AS label, length(body)::INTEGER AS bases, md5(body) AS seq_md5,
        md5(repeat(translate(md5(k || 'q'), '0123456789abcdef', '56789:;<=>?@ABCD'), 64)[length(seq) - length(body) + 1 : length(seq)]) AS qual_md5
        FROM planted JOIN base USING (k) JOIN bars c ON c.i = (k * 7 + 5) % 96 WHERE scenario IN ({kept})"""


_BC24 = _values([(i, f"BC{i + 1:02d}", s) for i, s in enumerate(kits.BC[:24])])
_CUT_TEXT = "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'After(' || o_orderkey % 5 || '):0' ELSE 'Before(' || o_orderkey % 4 || '):1,After(2):' || o_orderkey % 7 END"

ORACLES: dict[str, str] = {
    "fastq_header_split": r"""
        WITH heads AS (SELECT o_orderkey, 'read' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '  runid=' || o_orderkey || ' ch=1' ELSE chr(9) || 'barcode ' || o_orderkey END AS h FROM orders)
        SELECT o_orderkey, regexp_extract(h, '^\S*') AS read_id, ltrim(substr(h, length(regexp_extract(h, '^\S*')) + 1), ' ' || chr(9)) AS description FROM heads""",
    "reverse_complement": f"SELECT o_orderkey, reverse(translate({_dna('o_orderkey', 'a')} || 'RYKMBDHVNSWX', {COMPLEMENT})) AS seq FROM orders",
    "iupac_check": "SELECT o_orderkey, o_orderkey % 5 <> 0 AS valid FROM orders",
    "rel_dist": """SELECT o_orderkey, (CASE WHEN p <= 0 THEN 1 WHEN p <= 500 THEN p WHEN p = 1000 THEN -1 ELSE p - 1000 END)::INTEGER AS rel_dist
        FROM (SELECT o_orderkey, o_orderkey * 37 % 1003 - 1 AS p FROM orders)""",
    "edit_cutoff": "SELECT o_orderkey, greatest(0, ceil(0.51 * (o_orderkey % 200) - 1.7312 * sqrt(o_orderkey % 200)))::INTEGER AS cutoff FROM orders",
    "derive_reads_planted": f"""WITH {READS} SELECT 'read' || k AS read_id, 'order ' || k AS "desc", scenario, label, seq,
        repeat(translate(md5(k || 'q'), '0123456789abcdef', '56789:;<=>?@ABCD'), 64)[1 : length(seq)] AS qual FROM planted""",
    "listed_matches": f"""WITH {LISTS} SELECT read_id, anno_idx, read_len, rel_dist_to_end, read_start_bar, read_end_bar, read_start_flank, read_end_flank, read_start_bar AS bar_start,
        (read_start_bar + 23)::INTEGER AS bar_end, match_type, flank_cost, barcode_cost, label, strand FROM dist""",
    "trimmed_ends": f"""WITH {SEQS}, ends AS (SELECT k, seq, CASE WHEN k % 2 = 0 THEN 1 + k * 13 % 20 ELSE 0 END AS a, CASE WHEN k // 3 % 2 = 1 THEN 1 + k * 17 % 20 ELSE 0 END AS b FROM seqs)
        SELECT 'r' || k AS read_id, (length(seq) - a - b)::INTEGER AS bases, md5(seq[a + 1 : length(seq) - b]) AS seq_md5 FROM ends""",
    "residual_exact": f"""WITH {READS} SELECT 'read' || k AS read_id, coalesce(label, 'none') AS barcode, length(seq)::INTEGER AS len,
        CASE scenario WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END::INTEGER AS n_flank FROM planted""",
    "barcode_label_ranges": _spans(),
    "kit_catalog": "SELECT * FROM " + _values([(k, f, len(kits.FAMILIES[f][0]), "double" if kits.FAMILIES[f][1] else "single") for k, f in kits.KITS.items()]) + " t(kit, family, templates, labels)",
    "kit_catalog_expand": _catalog_expand(),
    "group_flanks": _group_flanks(),
    "approx_min_cost": _edit_distance(kits.BC[0], 64),
    "barcode_assign_margin": f"""WITH bars(i, label, bar) AS {_BC24},
        windows AS (SELECT o_orderkey, {_dna('o_orderkey', 'e')}[1 : o_orderkey % 9] || bar[o_orderkey % 9 + 1 : 24] AS w FROM orders JOIN bars ON i = o_orderkey % 24),
        costs AS (SELECT o_orderkey, bars.i, bars.label, levenshtein(w, bars.bar) AS cost FROM windows CROSS JOIN bars)
        SELECT o_orderkey, arg_min(label, cost * 100 + i) AS label, min(cost)::INTEGER AS cost, list_sort(list(cost))[2] - min(cost) >= 3 AS valid FROM costs GROUP BY o_orderkey""",
    "exact_planted_demux": _planted("1, 2"),
    "planted_slices": _planted("1, 2, 3"),
    "overlap_collapse": _collapse_pairs(8, 10),
    "overlap_collapse_half": _collapse_pairs(1, 2),
    "cuts_roundtrip": f"SELECT o_orderkey, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ',')) END::INTEGER AS n, t AS cuts FROM (SELECT o_orderkey, {_CUT_TEXT} AS t FROM orders)",
    "filter_dropped": _filtered(PAIR) + " SELECT read_id, anno_idx, cuts FROM filtered WHERE NOT kept",
    "filter_again": _filtered(PAIR) + f""", again AS (SELECT read_id, size >= 2 AND m0.match_type = 'Ftag' AND m1.match_type = 'Ftag' AS hit FROM side)
        SELECT read_id, coalesce(any_value(hit) AND count(*) = 2, false) AS kept,
               string_agg(cuts || CASE WHEN hit AND anno_idx = 0 THEN CASE WHEN cuts = '' THEN '' ELSE ',' END || 'Before(7):0' ELSE '' END, '|' ORDER BY anno_idx) AS cuts
        FROM filtered JOIN again USING (read_id) GROUP BY read_id""",
    "inspect_read_pattern": _structure(250) + " SELECT read_id, pattern FROM patterns",
    "inspect_topk": _structure(250) + " SELECT pattern, count(*)::BIGINT AS count FROM patterns GROUP BY pattern ORDER BY 2 DESC, 1 LIMIT 10",
    "inspect_unique": _structure(100) + " SELECT count(DISTINCT pattern)::BIGINT AS patterns, count(*)::BIGINT AS reads FROM patterns",
    "pull_reads": _slice(PAIR, _PAIR_ROWS, whole=True),
    "trim_pair": _slice(PAIR, _PAIR_ROWS),
    "trim_flip": _slice(PAIR, _PAIR_ROWS, flip=True),
    "trim_skip": _slice(PAIR, _PAIR_ROWS, whole=True),
    "trim_single_cut": _slice(SINGLE, f"SELECT k, read_id, 0 AS nth, m0.read_end_flank AS lo, n AS hi, {_tag('m0')} AS label, false AS turn FROM kept WHERE pick = 0 AND size = 1"),
    "trim_single_before": _slice(BEFORE, f"SELECT k, read_id, 0 AS nth, 0 AS lo, m1.read_start_flank AS hi, {_tag('m1')} AS label, false AS turn FROM kept WHERE pick = 0 AND size = 2"),
    "trim_multi_group": _slice(MULTI, _MULTI_ORDERED),
    "label_variants": _label_variants(),
    "stage_counters": _filtered(PAIR) + """, n AS (SELECT read_id, coalesce(pick = 0 AND m0.read_end_flank < m1.read_start_flank, false) AS ok FROM picked)
        SELECT 'trim' AS step, unnest(['total', 'trimmed', 'split', 'failed']) AS metric, unnest([count(*), count(*) FILTER (ok), 0, count(*) FILTER (NOT ok)])::BIGINT AS count FROM n""",
    "failed_reads": _filtered(PAIR) + " SELECT read_id FROM picked WHERE NOT coalesce(pick = 0 AND m0.read_end_flank < m1.read_start_flank, false)",
} | {name: _filter(p) for name, p in FILTERS.items()}
