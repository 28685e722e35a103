"""SQL of the bound, order and search queries: spanning trees by counting components, greedy choices as recursive tables."""

from __future__ import annotations

from cladeflow.functions import fitch, newick

#: Spanning tree weights of graphs ``dd`` (g, a, b, d): at each threshold, the components less one. ``last``: the longest edge.
SPANNING = """th AS (SELECT g, unnest(generate_series(0, max(d) - 1)) AS t FROM dd GROUP BY g),
  nodes AS (SELECT g, a AS v FROM dd UNION SELECT g, b FROM dd),
  links AS (SELECT g, a, b, d FROM dd UNION ALL SELECT g, b, a, d FROM dd),
  reach(g, t, v, w) AS (SELECT th.g, t, v, v FROM th JOIN nodes ON th.g = nodes.g UNION SELECT r.g, r.t, r.v, links.b FROM reach r JOIN links ON r.g = links.g AND r.w = links.a AND links.d <= r.t),
  tops AS (SELECT g, t, v, min(w) AS top FROM reach GROUP BY 1, 2, 3),
  comps AS (SELECT g, t, count(DISTINCT top) AS n FROM tops GROUP BY 1, 2),
  mst AS (SELECT g, CAST(sum(n - 1) AS BIGINT) AS weight, count(*) FILTER (n > 1) AS last FROM comps GROUP BY 1)"""
#: Costs of two sites by the pairs of bases they show, from the components of the graph of these pairs.
COSTS = """ms AS (SELECT DISTINCT mask16 AS m FROM sp), eb AS (SELECT m, k // 4 AS a, 4 + k % 4 AS b FROM ms, unnest(generate_series(0, 15)) t(k) WHERE (m >> CAST(k AS INTEGER)) & 1 = 1),
  ends AS (SELECT m, a AS v FROM eb UNION SELECT m, b FROM eb), e2 AS (SELECT m, a, b FROM eb UNION ALL SELECT m, b, a FROM eb),
  rr(m, v, w) AS (SELECT m, v, v FROM ends UNION SELECT r.m, r.v, e2.b FROM rr r JOIN e2 ON r.m = e2.m AND r.w = e2.a),
  cc AS (SELECT m, count(DISTINCT top) AS c, count(*) AS v FROM (SELECT m, v, min(w) AS top FROM rr GROUP BY 1, 2) GROUP BY 1),
  costs AS (SELECT m AS mask16, CAST(bit_count(m) + c - 2 AS INTEGER) AS cost, CAST(bit_count(m) - v + c AS INTEGER) AS extra FROM cc)"""


def _joins(parents: list[int], n: int) -> list[list[int]]:
    """Which places of a list of states are joined, each result at its end."""
    below, place, joins = newick.children(parents), {newick.node_of(t): t + 1 for t in range(n)}, []
    for v in reversed(newick.preorder(parents)):
        if newick.taxon_of(v) is None:
            joins.append([place[c] for c in below[v]])
            place[v] = n + len(joins)
    return [*joins, [1, place[below[0][0]]]]


def tree_values(n: int) -> str:
    """Every tree of ``n`` taxa as a row: its text and its joins."""
    trees = [newick.start()]
    for _ in range(n - 2):
        trees = [newick.insert(p, e) for p in trees for e in range(1, len(p))]
    return ", ".join(f"({n}, '{newick.to_newick(p)}', {_joins(p, n)})" for p in trees)


def prefix_values(n: int) -> str:
    """Every tree of the first 3 to ``n`` taxa as a row: the taxa, its text, the text of the tree before and the edge that grew, and its joins."""
    trees, rows = [newick.start()], []
    for k in range(3, n + 1):
        grown = [(newick.insert(p, e), p, e) for p in trees for e in range(1, len(p))]
        rows += [f"({k}, '{newick.to_newick(t)}', '{newick.to_newick(p)}', {e}, {_joins(t, k)})" for t, p, e in grown]
        trees = [t for t, _, _ in grown]
    return ", ".join(rows)


def comb(n: int) -> list[int]:
    """The tree of ``n`` taxa in which each hangs on the edge of the second."""
    parents = newick.start()
    for _ in range(n - 2):
        parents = newick.insert(parents, 1)
    return parents


def reconnection_values(n: int) -> str:
    """Every cut of the comb of ``n`` taxa and every way to join its sides: the edges, whether the tree is the old one, its text and its joins."""
    old, rows = comb(n), []
    for cut in range(1, len(old)):
        lower, upper = fitch.cut_sides(old, cut)
        for x in lower:
            for y in upper:
                tree = fitch.reconnected(old, cut, x, y)
                rows.append(f"({n}, {cut}, {x}, {y}, {str(newick.to_newick(tree) == newick.to_newick(old)).lower()}, '{newick.to_newick(tree)}', {_joins(tree, n)})")
    return ", ".join(rows)


def oracles(EMB: str, EVT: str, CHUNK: str, CHUNK6: str, FORCED: str, RECODED: str, RUNNING: str, SITE_PAIR: str, PAIR: str, SEEN: str) -> dict[str, str]:  # noqa: N803
    """By query; the arguments are the common tables of the alignments."""
    onset = "onset AS (SELECT aln_id, site, min(CASE WHEN forced IS NULL THEN taxon + 1 END) AS onset FROM running GROUP BY 1, 2)"
    inc = f"""WITH RECURSIVE {CHUNK}, {SITE_PAIR}, {RUNNING}, {onset}, {COSTS},
  inc AS (SELECT sp.aln_id, p, q, sp.mask16, cost, extra, least(x.onset, y.onset) AS onset FROM sp JOIN costs ON sp.mask16 = costs.mask16
    JOIN onset x ON x.aln_id = sp.aln_id AND x.site = p JOIN onset y ON y.aln_id = sp.aln_id AND y.site = q WHERE extra > 0)"""
    # parts of four neighbouring sites, by the first site of each pattern
    parts = f"""WITH RECURSIVE {CHUNK}, {RECODED}, ps AS (SELECT aln_id, site, site // 4 AS part_id, row_number() OVER (PARTITION BY aln_id, site // 4 ORDER BY site) - 1 AS pos FROM pats),
  pc AS (SELECT cells.aln_id, cells.site, taxon, mask, part_id, pos FROM cells JOIN ps ON cells.aln_id = ps.aln_id AND cells.site = ps.site)"""
    greedy_pairs = """rec(aln_id, step, used, total) AS (SELECT aln_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(0 AS BIGINT) FROM names
    UNION ALL SELECT rec.aln_id, step + 1, CASE WHEN list_contains(used, p) OR list_contains(used, q) THEN used ELSE list_concat(used, [p, q]) END,
      CASE WHEN list_contains(used, p) OR list_contains(used, q) THEN total ELSE total + gain END FROM rec JOIN ranked ON rec.aln_id = ranked.aln_id AND nr = step + 1),
  taken AS (SELECT aln_id, max(total) AS total FROM rec GROUP BY 1)"""
    whole = "big AS (SELECT aln_id, count(DISTINCT taxon) AS n FROM cells GROUP BY 1 HAVING count(DISTINCT taxon) >= 4)"

    def order(value: str) -> str:
        swap = lambda row, a, b: f"list_transform({row}, lambda x: CASE WHEN x = {a} THEN {b} WHEN x = {b} THEN {a} ELSE x END)"
        return f"""WITH RECURSIVE {EMB}, {PAIR}, whole AS (SELECT aln_id, i, j, dist FROM pr UNION ALL SELECT aln_id, j, i, dist FROM pr UNION ALL SELECT DISTINCT aln_id, taxon, taxon, 0 FROM cells),
  lines AS (SELECT aln_id, i, list(dist ORDER BY j) AS r FROM whole GROUP BY 1, 2), mat AS (SELECT aln_id, list(r ORDER BY i) AS m, count(*) AS n FROM lines GROUP BY 1),
  far AS (SELECT aln_id, i, j FROM pr QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY dist DESC, i, j) = 1),
  one AS (SELECT aln_id, m, n, j, {swap("range(n)", "0", "i")} AS o FROM mat JOIN far USING (aln_id)),
  rec(aln_id, m, n, k, o) AS (SELECT aln_id, m, n, CAST(2 AS BIGINT), {swap("o", "o[2]", "j")} FROM one
    UNION ALL SELECT aln_id, m, n, k + 1, {swap("o", "o[k + 1]", "o[best]")} FROM (SELECT *, -(list_reverse_sort(list_transform(generate_series(k + 1, n), lambda c: {{'v': {value}, 'x': -c}}))[1]['x']) AS best FROM rec WHERE k < n))
  SELECT aln_id, unnest(generate_series(0, n - 1)) AS rank, unnest(o) AS taxon FROM rec WHERE k = n"""

    # lengths of the trees of the first taxa of each alignment, and the greedy tree
    prefix = f"""WITH RECURSIVE {CHUNK6}, {RECODED}, trees(k, newick, before, edge, joins) AS (VALUES {prefix_values(6)}),
  n AS (SELECT aln_id, max(len(states)) AS n FROM pats GROUP BY 1 HAVING max(len(states)) >= 4),
  rec(aln_id, k, newick, before, edge, joins, weight, l, cost, step) AS (SELECT aln_id, k, newick, before, edge, joins, weight, states[1:k], CAST(0 AS BIGINT), 1 FROM pats JOIN n USING (aln_id) JOIN trees ON k <= n
    UNION ALL SELECT aln_id, k, newick, before, edge, joins, weight, list_append(l, CASE WHEN l[x] & l[y] <> 0 THEN l[x] & l[y] ELSE l[x] | l[y] END), cost + CASE WHEN l[x] & l[y] = 0 THEN weight ELSE 0 END, step + 1 FROM (SELECT *, joins[step][1] AS x, joins[step][2] AS y FROM rec WHERE step <= len(joins))),
  scored AS (SELECT aln_id, k, newick, before, edge, CAST(sum(cost) AS BIGINT) AS score FROM rec WHERE step = len(joins) + 1 GROUP BY ALL),
  steps(aln_id, k, newick, score) AS (SELECT aln_id, 2, '(1,2)', CAST(0 AS BIGINT) FROM n
    UNION ALL SELECT aln_id, k, newick, score FROM (SELECT s.aln_id, s.k, s.newick, s.score, row_number() OVER (PARTITION BY s.aln_id ORDER BY s.score, s.edge) AS nr FROM steps JOIN scored s ON s.aln_id = steps.aln_id AND s.k = steps.k + 1 AND s.before = steps.newick) WHERE nr = 1),
  greedy AS (SELECT steps.aln_id, newick, score AS length FROM steps JOIN n ON n.aln_id = steps.aln_id AND n.n = steps.k)"""
    chosen = "list_transform(o[1:k], lambda t: m[o[c] + 1][t + 1])"
    return {
        "h1_spanning_tree": f"WITH RECURSIVE {EMB}, {PAIR}, dd AS (SELECT aln_id AS g, i AS a, j AS b, dist AS d FROM pr), {SPANNING} SELECT DISTINCT dd.g AS aln_id, coalesce(weight, 0) AS weight FROM dd LEFT JOIN mst ON dd.g = mst.g",
        "h2_upper_bound": f"""WITH RECURSIVE {EMB}, {FORCED}, told AS (SELECT cells.* FROM cells JOIN forced USING (aln_id, site) WHERE forced IS NULL),
  dd AS (SELECT a.aln_id AS g, a.taxon AS a, b.taxon AS b, CAST(sum(CASE WHEN a.mask <> b.mask THEN 1 ELSE 0 END) AS BIGINT) AS d FROM told a JOIN told b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon GROUP BY 1, 2, 3), {SPANNING},
  fixed AS (SELECT aln_id, coalesce(sum(forced), 0) AS fixed FROM forced GROUP BY 1) SELECT aln_id, CAST(fixed + coalesce(weight, 0) AS BIGINT) AS upper FROM fixed LEFT JOIN mst ON aln_id = g""",
        "h3_spanning_rest_bound": f"""WITH RECURSIVE {CHUNK}, {whole}, fs AS (SELECT aln_id, unnest(generate_series(3, n - 1)) AS f FROM big),
  united AS (SELECT cells.aln_id, f, site, CASE WHEN taxon < f THEN -1 ELSE taxon END AS v, bit_or(mask) AS mask FROM cells JOIN fs ON cells.aln_id = fs.aln_id GROUP BY 1, 2, 3, 4),
  dd AS (SELECT {{'aln_id': a.aln_id, 'f': a.f}} AS g, a.v AS a, b.v AS b, CAST(sum(CASE WHEN a.mask & b.mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM united a JOIN united b ON a.aln_id = b.aln_id AND a.f = b.f AND a.site = b.site AND a.v < b.v GROUP BY 1, 2, 3), {SPANNING}
  SELECT fs.aln_id, f - 1 AS k, coalesce(weight, 0) // 2 AS bound FROM fs LEFT JOIN mst ON g.aln_id = fs.aln_id AND g.f = fs.f""",
        "h4_j6_j7_incompatible_pairs": f"{inc} SELECT * FROM inc",
        "s8_incompatibility_graph": f"""{inc}, keyed AS (SELECT aln_id, p, q, unnest(generate_series(3, onset - 1)) AS k FROM inc WHERE onset > 3), wide AS (SELECT aln_id, count(DISTINCT site) AS n FROM cells GROUP BY 1)
  SELECT aln_id, k, row_number() OVER (PARTITION BY aln_id, k ORDER BY p, q) AS line_no, 'e ' || (p + 1) || ' ' || (q + 1) AS line FROM keyed
  UNION ALL SELECT keyed.aln_id, k, 0, 'p clq ' || count(*) || ' ' || max(n) FROM keyed JOIN wide ON keyed.aln_id = wide.aln_id GROUP BY 1, 2""",
        "h5_incompatibility_bound": f"""{inc}, {RECODED}, keyed AS (SELECT inc.aln_id, unnest(generate_series(3, onset - 1)) AS k, p, q, extra FROM inc JOIN pats x ON x.aln_id = inc.aln_id AND x.site = p JOIN pats y ON y.aln_id = inc.aln_id AND y.site = q WHERE onset > 3),
  sides AS (SELECT aln_id, k, p AS s FROM keyed UNION ALL SELECT aln_id, k, q FROM keyed), deg AS (SELECT aln_id, k, s, count(*) AS n FROM sides GROUP BY 1, 2, 3),
  ranked AS (SELECT keyed.*, row_number() OVER (PARTITION BY keyed.aln_id, keyed.k ORDER BY extra DESC, a.n + b.n, p, q) AS nr FROM keyed JOIN deg a ON a.aln_id = keyed.aln_id AND a.k = keyed.k AND a.s = p JOIN deg b ON b.aln_id = keyed.aln_id AND b.k = keyed.k AND b.s = q),
  copies AS (SELECT aln_id, list(coalesce(weight, 0) ORDER BY site) AS l FROM (SELECT DISTINCT aln_id, site FROM cells) LEFT JOIN pats USING (aln_id, site) GROUP BY 1),
  rec(aln_id, k, step, l, n, total) AS (SELECT DISTINCT keyed.aln_id, k, CAST(0 AS BIGINT), l, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM keyed JOIN copies ON keyed.aln_id = copies.aln_id
    UNION ALL SELECT rec.aln_id, rec.k, step + 1, list_transform(l, lambda x, i: CASE WHEN i = p + 1 OR i = q + 1 THEN x - least(l[p + 1], l[q + 1]) ELSE x END), n + least(l[p + 1], l[q + 1]), total + extra * least(l[p + 1], l[q + 1])
      FROM rec JOIN ranked ON rec.aln_id = ranked.aln_id AND rec.k = ranked.k AND nr = step + 1)
  SELECT aln_id, k - 1 AS k, max(n) AS bound, max(total) AS cost FROM rec GROUP BY 1, 2""",
        "h6_part_bounds": f"""{parts}, {SEEN}, lists AS (SELECT aln_id, part_id, taxon, list(mask ORDER BY site) AS r FROM pc GROUP BY 1, 2, 3), dr AS (SELECT aln_id, part_id, r, min(taxon) AS v FROM lists GROUP BY 1, 2, 3),
  dd AS (SELECT {{'aln_id': x.aln_id, 'part_id': x.part_id}} AS g, x.v AS a, y.v AS b, count(*) FILTER (cx.mask & cy.mask = 0) AS d FROM dr x JOIN dr y ON x.aln_id = y.aln_id AND x.part_id = y.part_id AND x.v < y.v
    JOIN pc cx ON cx.aln_id = x.aln_id AND cx.part_id = x.part_id AND cx.taxon = x.v JOIN pc cy ON cy.aln_id = y.aln_id AND cy.site = cx.site AND cy.taxon = y.v GROUP BY 1, 2, 3), {SPANNING},
  per AS (SELECT aln_id, part_id, site, count(DISTINCT mask) - 1 AS single, 3 - greatest(count(*) FILTER (taxon < 3 AND mask = 1), count(*) FILTER (taxon < 3 AND mask = 2), count(*) FILTER (taxon < 3 AND mask = 4), count(*) FILTER (taxon < 3 AND mask = 8)) AS up FROM pc GROUP BY 1, 2, 3),
  sums AS (SELECT aln_id, part_id, sum(single) AS single, sum(up) AS up, count(*) AS width FROM per GROUP BY 1, 2),
  added AS (SELECT pc.aln_id, part_id, count(*) FILTER (pc.taxon >= 3 AND pc.mask & seen = 0) AS additive FROM pc JOIN seen_ ON seen_.aln_id = pc.aln_id AND seen_.site = pc.site AND seen_.taxon = pc.taxon GROUP BY 1, 2),
  n AS (SELECT aln_id, part_id, count(*) AS n FROM dr GROUP BY 1, 2),
  gs AS (SELECT g, t, top, count(*) AS c FROM tops GROUP BY 1, 2, 3),
  ga AS (SELECT dd.g, x.t, least(x.top, y.top) AS a, greatest(x.top, y.top) AS b, min(d) AS d FROM dd JOIN tops x ON x.g = dd.g AND x.v = dd.a JOIN tops y ON y.g = dd.g AND y.t = x.t AND y.v = dd.b WHERE x.top <> y.top GROUP BY 1, 2, 3, 4),
  two AS (SELECT ga.g, max(x.c + y.c + d) - 2 AS two FROM ga JOIN gs x ON x.g = ga.g AND x.t = ga.t AND x.top = a JOIN gs y ON y.g = ga.g AND y.t = ga.t AND y.top = b GROUP BY 1),
  three AS (SELECT p.g, max(x.c + y.c + z.c - 3 + least(p.d + q.d + r.d - greatest(p.d, q.d, r.d), (p.d + q.d + r.d + 1) // 2)) AS three FROM ga p JOIN ga q ON q.g = p.g AND q.t = p.t AND q.a = p.b JOIN ga r ON r.g = p.g AND r.t = p.t AND r.a = p.a AND r.b = q.b
    JOIN gs x ON x.g = p.g AND x.t = p.t AND x.top = p.a JOIN gs y ON y.g = p.g AND y.t = p.t AND y.top = p.b JOIN gs z ON z.g = p.g AND z.t = p.t AND z.top = q.b GROUP BY 1),
  grouped AS (SELECT mst.g, weight, last, two, coalesce(three, 0) AS three FROM mst JOIN two ON two.g = mst.g LEFT JOIN three ON three.g = mst.g),
  lows AS (SELECT sums.aln_id, sums.part_id, CAST(greatest(single, (coalesce(weight, 0) + 1) // 2, n - 1, coalesce(n - 2 + last, 0), coalesce(two, 0), coalesce(three, 0), CASE WHEN width = 2 THEN coalesce(weight, 0) ELSE 0 END) AS BIGINT) AS lower, CAST(up AS BIGINT) AS upper, width
    FROM sums JOIN n USING (aln_id, part_id) LEFT JOIN grouped ON g.aln_id = sums.aln_id AND g.part_id = sums.part_id)
  SELECT aln_id, part_id, lower, upper, additive, greatest(additive, lower - upper) AS final, width FROM lows JOIN added USING (aln_id, part_id)""",
        "h7_two_way_scores": f"""{parts}, wide AS (SELECT aln_id, part_id, count(*) AS w FROM ps GROUP BY 1, 2), subs AS (SELECT aln_id, part_id, w, unnest(generate_series(1, (1 << CAST(w AS INTEGER)) - 1)) AS s FROM wide),
  sc AS (SELECT pc.aln_id, pc.part_id, s, site, taxon, mask FROM pc JOIN subs ON pc.aln_id = subs.aln_id AND pc.part_id = subs.part_id AND (s >> CAST(pos AS INTEGER)) & 1 = 1),
  lists AS (SELECT aln_id, part_id, s, taxon, list(mask ORDER BY site) AS r FROM sc GROUP BY 1, 2, 3, 4), dr AS (SELECT aln_id, part_id, s, r, min(taxon) AS v FROM lists GROUP BY 1, 2, 3, 4),
  dd AS (SELECT {{'aln_id': x.aln_id, 'part_id': x.part_id, 's': x.s}} AS g, x.v AS a, y.v AS b, CAST(list_sum(list_transform(generate_series(1, len(x.r)), lambda i: CASE WHEN x.r[i] <> y.r[i] THEN 1 ELSE 0 END)) AS BIGINT) AS d
    FROM dr x JOIN dr y ON x.aln_id = y.aln_id AND x.part_id = y.part_id AND x.s = y.s AND x.v < y.v), {SPANNING},
  n AS (SELECT aln_id, part_id, s, count(*) AS n FROM dr GROUP BY 1, 2, 3),
  simple AS (SELECT n.aln_id, n.part_id, n.s, CASE WHEN n < 2 THEN 0 ELSE n - 2 + last END AS score FROM n LEFT JOIN mst ON g.aln_id = n.aln_id AND g.part_id = n.part_id AND g.s = n.s),
  full_ AS (SELECT simple.* FROM simple JOIN wide USING (aln_id, part_id) WHERE s = (1 << CAST(w AS INTEGER)) - 1),
  split AS (SELECT a.aln_id, a.part_id, max(a.score + b.score) AS best FROM simple a JOIN full_ f ON f.aln_id = a.aln_id AND f.part_id = a.part_id JOIN simple b ON b.aln_id = a.aln_id AND b.part_id = a.part_id AND b.s = f.s - a.s GROUP BY 1, 2)
  SELECT aln_id, part_id, score, greatest(score, coalesce(best, 0)) AS best FROM full_ LEFT JOIN split USING (aln_id, part_id)""",
        "h12_surplus_bound": f"""WITH RECURSIVE {CHUNK}, {SITE_PAIR}, {COSTS}, own AS (SELECT aln_id, site, count(DISTINCT mask) AS n FROM cells GROUP BY 1, 2), names AS (SELECT aln_id, sum(n - 1) AS base FROM own GROUP BY 1),
  more AS (SELECT sp.aln_id, p, q, bit_count(mask16) - x.n - y.n + 1 AS gain FROM sp JOIN own x ON x.aln_id = sp.aln_id AND x.site = p JOIN own y ON y.aln_id = sp.aln_id AND y.site = q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY aln_id ORDER BY gain DESC, p, q) AS nr FROM more WHERE gain > 0), {greedy_pairs}
  SELECT aln_id, CAST(base + total AS BIGINT) AS bound FROM names JOIN taken USING (aln_id)""",
        "h14_whole_lower_bound": f"""WITH RECURSIVE {CHUNK}, {whole}, {RECODED}, {FORCED}, {SITE_PAIR}, {COSTS}, told AS (SELECT aln_id, site, weight, forced FROM pats JOIN forced USING (aln_id, site) JOIN big USING (aln_id)),
  names AS (SELECT aln_id, coalesce(sum(weight * forced), 0) AS fixed FROM told GROUP BY 1), inf AS (SELECT * FROM told WHERE forced IS NULL),
  singles AS (SELECT aln_id, sum(weight * (n - 1)) AS single FROM inf JOIN (SELECT aln_id, site, count(DISTINCT mask) AS n FROM cells GROUP BY 1, 2) USING (aln_id, site) GROUP BY 1),
  ranked AS (SELECT sp.aln_id, p, q, least(x.weight, y.weight) * extra AS gain, row_number() OVER (PARTITION BY sp.aln_id ORDER BY p, q) AS nr FROM sp JOIN costs ON sp.mask16 = costs.mask16 JOIN inf x ON x.aln_id = sp.aln_id AND x.site = p JOIN inf y ON y.aln_id = sp.aln_id AND y.site = q WHERE extra > 0), {greedy_pairs},
  dd AS (SELECT a.aln_id AS g, a.taxon AS a, b.taxon AS b, CAST(sum(CASE WHEN a.mask & b.mask = 0 THEN weight ELSE 0 END) AS BIGINT) AS d FROM cells a JOIN inf ON a.aln_id = inf.aln_id AND a.site = inf.site JOIN cells b ON a.aln_id = b.aln_id AND a.site = b.site AND a.taxon < b.taxon GROUP BY 1, 2, 3), {SPANNING}
  SELECT names.aln_id, CAST(fixed + greatest(coalesce(single, 0) + total, (coalesce(weight, 0) + 1) // 2) AS BIGINT) AS lower FROM names LEFT JOIN singles ON singles.aln_id = names.aln_id JOIN taken ON taken.aln_id = names.aln_id LEFT JOIN mst ON g = names.aln_id""",
        "o2_max_min_order": order(f"list_sort({chosen})"),
        "o3_max_sum_order": order(f"list_sum({chosen})"),
        "j7_incompatible_ambiguous": f"""WITH RECURSIVE {EVT}, rec(aln_id, p, q, r) AS (SELECT a.aln_id, a.site, b.site, list(DISTINCT {{'x': a.mask, 'y': b.mask}}) FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.taxon = b.taxon AND a.site < b.site GROUP BY 1, 2, 3
    UNION ALL SELECT aln_id, p, q, s FROM (SELECT *, list_filter(r, lambda u: len(list_filter(r, lambda o: o <> u AND (o.x & u.x) <> 0)) > 0 AND len(list_filter(r, lambda o: o <> u AND (o.y & u.y) <> 0)) > 0) AS s FROM rec) WHERE len(s) < len(r))
  SELECT aln_id, p, q, min(len(r)) > 2 AS incompatible FROM rec GROUP BY 1, 2, 3""",
        "t4_rounds_greedy_trees": f"{prefix} SELECT * FROM greedy",
        "a15_t6_counters": f"""{prefix}, {SEEN}, shown AS (SELECT aln_id, taxon, count(*) FILTER (mask & seen = 0) AS n_new FROM seen_ GROUP BY 1, 2),
  rest AS (SELECT aln_id, taxon AS k, coalesce(sum(n_new) OVER (PARTITION BY aln_id ORDER BY taxon DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound FROM shown),
  judged AS (SELECT s.*, s.score + bound <= length AS fits FROM scored s JOIN greedy USING (aln_id) JOIN rest ON rest.aln_id = s.aln_id AND rest.k = s.k - 1),
  kept(aln_id, k, newick, score) AS (SELECT aln_id, 2, '(1,2)', CAST(0 AS BIGINT) FROM n UNION ALL SELECT j.aln_id, j.k, j.newick, j.score FROM kept JOIN judged j ON j.aln_id = kept.aln_id AND j.k = kept.k + 1 AND j.before = kept.newick WHERE fits),
  levels AS (SELECT k.aln_id, k.k + 1 AS level, count(*) * CASE WHEN k.k = 2 THEN 1 ELSE 2 * k.k - 3 END AS tried FROM kept k JOIN n ON n.aln_id = k.aln_id WHERE k.k < n.n GROUP BY k.aln_id, k.k),
  counts AS (SELECT aln_id, k AS level, count(*) AS kept FROM kept GROUP BY 1, 2), ties AS (SELECT kept.aln_id, count(*) AS ties FROM kept JOIN n ON n.aln_id = kept.aln_id AND n.n = kept.k JOIN (SELECT aln_id, k, min(score) AS score FROM kept GROUP BY 1, 2) b ON b.aln_id = kept.aln_id AND b.k = kept.k AND b.score = kept.score GROUP BY 1)
  SELECT levels.aln_id, levels.level, CAST(tried AS BIGINT) AS tried, coalesce(kept, 0) AS kept, CAST(tried - coalesce(kept, 0) AS BIGINT) AS pruned, CASE WHEN levels.level = n.n THEN coalesce(kept, 0) ELSE 0 END AS "full", CASE WHEN levels.level = n.n THEN coalesce(ties, 0) ELSE 0 END AS ties
  FROM levels JOIN n ON n.aln_id = levels.aln_id LEFT JOIN counts ON counts.aln_id = levels.aln_id AND counts.level = levels.level LEFT JOIN ties ON ties.aln_id = levels.aln_id""",
        "t8_j10_reconnections": f"""WITH RECURSIVE {CHUNK6}, {RECODED}, trees(n, cut, below, above, old, newick, joins) AS (VALUES {reconnection_values(4)}, {reconnection_values(5)}, {reconnection_values(6)}),
  rec(aln_id, cut, below, above, old, newick, joins, weight, l, cost, step) AS (SELECT aln_id, cut, below, above, old, newick, joins, weight, states, CAST(0 AS BIGINT), 1 FROM pats JOIN trees ON len(states) = n
    UNION ALL SELECT aln_id, cut, below, above, old, newick, joins, weight, list_append(l, CASE WHEN l[x] & l[y] <> 0 THEN l[x] & l[y] ELSE l[x] | l[y] END), cost + CASE WHEN l[x] & l[y] = 0 THEN weight ELSE 0 END, step + 1 FROM (SELECT *, joins[step][1] AS x, joins[step][2] AS y FROM rec WHERE step <= len(joins))),
  scored AS (SELECT aln_id, cut, below, above, old, newick, sum(cost) AS score FROM rec WHERE step = len(joins) + 1 GROUP BY ALL)
  SELECT aln_id, cut, below, above, newick, CAST(max(score) FILTER (old) OVER (PARTITION BY aln_id) - score AS BIGINT) AS gain FROM scored""",
        "t6_exact_search": f"""WITH RECURSIVE {CHUNK6}, {RECODED}, trees(n, newick, joins) AS (VALUES {tree_values(4)}, {tree_values(5)}, {tree_values(6)}),
  rec(aln_id, newick, joins, weight, l, cost, step) AS (SELECT aln_id, newick, joins, weight, states, CAST(0 AS BIGINT), 1 FROM pats JOIN trees ON len(states) = n
    UNION ALL SELECT aln_id, newick, joins, weight, list_append(l, CASE WHEN l[x] & l[y] <> 0 THEN l[x] & l[y] ELSE l[x] | l[y] END), cost + CASE WHEN l[x] & l[y] = 0 THEN weight ELSE 0 END, step + 1 FROM (SELECT *, joins[step][1] AS x, joins[step][2] AS y FROM rec WHERE step <= len(joins)))
  SELECT aln_id, newick, CAST(sum(cost) AS BIGINT) AS score FROM rec WHERE step = len(joins) + 1 GROUP BY 1, 2 QUALIFY sum(cost) = min(sum(cost)) OVER (PARTITION BY aln_id)""",
    }
