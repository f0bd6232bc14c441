"""The queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

PRESENT = "TIMESTAMP '2024-01-31 00:00:00'"

#: Named steps, in order; a query gets those that it needs.
STEPS = {
    "ev": """SELECT CASE WHEN user_id % 10 = 9 THEN 'hmrtmp' ELSE 'u' END || user_id AS u, 'p' || json_extract_string(props, '$.k') AS p, event_type AS activity, ts, event_id, user_id % 10 = 9 AS anonymous FROM events""",
    "kind": """SELECT * FROM (VALUES ('purchase', 5, TRUE, 1.0::DOUBLE, 1.0::DOUBLE), ('signup', 4, FALSE, 1.5::DOUBLE, 1.0::DOUBLE), ('click', 3, FALSE, 1.0::DOUBLE, 1.0::DOUBLE), ('error', 2, FALSE, 1.0::DOUBLE, 1.2::DOUBLE)) t(activity, rating, blocking, in_boost, out_boost)""",
    "act": "SELECT ev.* FROM ev WHERE activity <> 'view' AND p IS NOT NULL AND u IS NOT NULL",
    "imp": "SELECT * FROM ev WHERE activity = 'view' AND p IS NOT NULL AND u IS NOT NULL",
    "summary": "SELECT u, p, max({'t': ts, 'a': activity}).a AS activity, date_trunc('day', max(ts)) AS day, max(ts) AS ts FROM act GROUP BY u, p",
    "named": "SELECT * FROM summary WHERE NOT starts_with(u, 'hmrtmp')",
    "shown": "SELECT imp.u, imp.p, CAST(sum(CASE WHEN s.ts IS NULL OR imp.ts > s.ts THEN 1 ELSE 0 END) AS BIGINT) AS n, min(imp.ts) AS first FROM imp LEFT JOIN summary s ON imp.u = s.u AND imp.p = s.p GROUP BY imp.u, imp.p",
    "pop": "SELECT p, min(day) AS first, max(day) AS latest, count(*) AS n, count(*) / (date_diff('day', min(day), max(day)) + 1) AS popularity FROM named JOIN kind USING (activity) WHERE rating >= 3 GROUP BY p",
    "rated": "SELECT u, p, rating FROM named JOIN kind USING (activity)",
    "uu_num": "SELECT a.u AS u, b.u AS t, count(*) AS nc, CAST(sum(CASE WHEN a.rating >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS na FROM rated a JOIN rated b ON a.p = b.p AND a.u <> b.u WHERE a.rating >= 3 AND b.rating >= 4 GROUP BY a.u, b.u",
    "uu_den": "SELECT u AS t, count(*) AS den FROM rated WHERE rating >= 4 GROUP BY u",
    "uu": "SELECT u, t, nc, na, coalesce(den, 0) AS den, CASE WHEN coalesce(den, 0) = 0 THEN 0.0::DOUBLE ELSE (na * 0.8::DOUBLE + nc * 0.19999999999999996::DOUBLE) / den END AS s0 FROM uu_num LEFT JOIN uu_den USING (t)",
    "uus": "SELECT u, t, nc, na, den, CASE WHEN s0 < 0.0001 THEN 0.0::DOUBLE ELSE s0 END AS s FROM uu",
    "pp_num": "SELECT a.p AS p, b.p AS t, count(*) AS nc, CAST(sum(CASE WHEN b.rating >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS na FROM rated a JOIN rated b ON a.u = b.u AND a.p <> b.p WHERE a.rating >= 3 AND b.rating >= 3 GROUP BY a.p, b.p",
    "pp_den": "SELECT p, count(*) AS den FROM rated WHERE rating >= 3 GROUP BY p",
    "pps": "SELECT p, t, nc, na, den, CASE WHEN s0 < 0.0001 THEN 0.0::DOUBLE ELSE s0 END AS s FROM (SELECT p, t, nc, na, coalesce(den, 0) AS den, CASE WHEN coalesce(den, 0) = 0 THEN 0.0::DOUBLE ELSE (na * 0.8::DOUBLE + nc * 0.19999999999999996::DOUBLE) / den END AS s0 FROM pp_num LEFT JOIN pp_den USING (p))",
    "ut": "SELECT * FROM (SELECT u, t, s, row_number() OVER (PARTITION BY u ORDER BY s DESC, t) AS place FROM uus WHERE s > 0) WHERE place <= 50",
    "pt": "SELECT * FROM (SELECT p, t, s, row_number() OVER (PARTITION BY p ORDER BY s DESC, t) AS place FROM pps WHERE s > 0) WHERE place <= 150",
    "recent": "SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY u) AS last FROM summary) WHERE day >= last - INTERVAL 30 DAY",
    "blocked": "SELECT DISTINCT u, p FROM recent JOIN kind USING (activity) WHERE blocking",
    "bases": "SELECT * FROM (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY ts DESC, p) - 1 AS base_rank FROM recent) WHERE base_rank < 15",
    "lent": f"SELECT u AS t, p, out_boost FROM named JOIN kind USING (activity) WHERE rating >= 4 AND day >= {PRESENT} - INTERVAL 30 DAY",
    "product": f"""SELECT 'p' || doc_id AS p, 'x-' || lang AS language, p_type AS category, source, coalesce(p_name, 'document ' || doc_id) AS title, text AS full_content, p_retailprice AS price,
      {PRESENT} - to_days(CAST(doc_id % 40 + 1 AS INTEGER)) AS date, {PRESENT} - to_days(CAST(doc_id % 40 + 1 AS INTEGER)) + INTERVAL 30 DAY AS expiration_date,
      CASE WHEN doc_id % 17 = 16 THEN TIMESTAMP '2024-01-25 00:00:00' END AS deleted_on FROM documents LEFT JOIN part ON doc_id = p_partkey""",
    "live": "SELECT * FROM product WHERE deleted_on IS NULL AND full_content IS NOT NULL",
    "model": f"SELECT *, pow(2.0::DOUBLE, -date_diff('day', date, {PRESENT}) / 4.0::DOUBLE) AS age FROM live",
    "words": r"""SELECT p, language, attribute, unnest(regexp_extract_all(trim(translate(lower(regexp_replace(txt, ' +', ' ', 'g')), chr(10) || chr(9) || '.,?!$"', '')), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')) AS term
      FROM (SELECT p, language, 'title' AS attribute, title AS txt FROM live UNION ALL SELECT p, language, 'full_content', full_content FROM live)""",
    "tf": "SELECT p, language, attribute, term, count(*) AS n FROM words GROUP BY ALL",
    "df": "SELECT language, term, count(DISTINCT p) AS df FROM tf GROUP BY language, term",
    "raw": "SELECT p, language, attribute, term, n / max(n) OVER (PARTITION BY p, attribute) * ln((SELECT count(*) FROM product WHERE deleted_on IS NULL) / (1 + df)) AS raw FROM tf JOIN df USING (language, term)",
    "norm": "SELECT p, language, attribute, term, raw / most AS w FROM (SELECT *, max(raw) OVER (PARTITION BY p, attribute) AS most FROM raw) WHERE most > 0 AND raw > 0",
    "tfidf": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, attribute ORDER BY w DESC, term DESC) AS place FROM norm) WHERE place <= 200",
    "whole": "SELECT p, attribute, sum(w) AS whole FROM tfidf GROUP BY p, attribute",
    "sims": """SELECT a.p AS p, b.p AS t, a.attribute, sum(a.w / whole * (1 - greatest(0.0::DOUBLE, a.w - b.w))) AS sim FROM tfidf a JOIN whole ON whole.p = a.p AND whole.attribute = a.attribute
      JOIN tfidf b ON a.language = b.language AND a.attribute = b.attribute AND a.term = b.term AND a.p <> b.p GROUP BY a.p, b.p, a.attribute""",
    "texts": "SELECT p, t, sum(sim * CASE attribute WHEN 'title' THEN 0.1::DOUBLE ELSE 0.6::DOUBLE END) AS words FROM sims GROUP BY p, t",
    "content": """SELECT p, t, CASE WHEN s < 0.0001 THEN 0.0::DOUBLE ELSE s END AS s FROM (SELECT x.p, x.t, round(words + (CASE WHEN a.category = b.category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.1::DOUBLE + CASE WHEN a.source = b.source THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.1::DOUBLE
      + CASE WHEN coalesce(a.price, 100) = 0 AND coalesce(b.price, 100) = 0 THEN 1.0::DOUBLE ELSE least(coalesce(a.price, 100), coalesce(b.price, 100)) / greatest(coalesce(a.price, 100), coalesce(b.price, 100)) END * 0.1::DOUBLE), 12) AS s
      FROM texts x JOIN live a ON a.p = x.p JOIN live b ON b.p = x.t)""",
    "ct": "SELECT * FROM (SELECT p, t, s, row_number() OVER (PARTITION BY p ORDER BY s DESC, t) AS place FROM content WHERE s > 0) WHERE place <= 150",
    "users": "SELECT DISTINCT u FROM ev",
    "boosts": "SELECT u, p, in_boost FROM recent JOIN kind USING (activity)",
    "pop_raw": f"SELECT users.u, top.p, popularity AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2 FROM users, (SELECT * FROM pop WHERE latest >= {PRESENT} - INTERVAL 5 DAY AND popularity > 0 ORDER BY popularity DESC, p DESC LIMIT 500) top",
    "ubcf_raw": "SELECT ut.u, lent.p, round(sum(s * out_boost), 12) AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2 FROM ut JOIN lent ON ut.t = lent.t GROUP BY ut.u, lent.p HAVING round(sum(s * out_boost), 12) <> 0",
}


#: Strengths where impressions count, and what is made of them.
STEPS["uui"] = """SELECT x.u AS u, x.t AS t, nc, na, CAST(coalesce(den, 0) AS BIGINT) AS den, CASE WHEN coalesce(den, 0) = 0 THEN 0.0::DOUBLE WHEN (na * 0.8::DOUBLE + nc * 0.19999999999999996::DOUBLE) / den < 0.0001 THEN 0.0::DOUBLE ELSE (na * 0.8::DOUBLE + nc * 0.19999999999999996::DOUBLE) / den END AS s
  FROM (SELECT a.u AS u, b.u AS t, count(*) AS nc, CAST(sum(CASE WHEN a.rating >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS na FROM (SELECT rated.* FROM rated SEMI JOIN shown ON shown.u = rated.u AND shown.p = rated.p) a JOIN rated b ON a.p = b.p AND a.u <> b.u WHERE a.rating >= 3 AND b.rating >= 4 GROUP BY a.u, b.u) x
  LEFT JOIN (SELECT shown.u AS u, rated.u AS t, count(*) AS den FROM shown JOIN rated ON shown.p = rated.p WHERE rating >= 4 GROUP BY shown.u, rated.u) d ON d.u = x.u AND d.t = x.t"""
STEPS["ppi"] = """SELECT x.p AS p, x.t AS t, nc, na, CAST(coalesce(den, 0) AS BIGINT) AS den, CASE WHEN coalesce(den, 0) = 0 THEN 0.0::DOUBLE WHEN (na * 0.8::DOUBLE + nc * 0.19999999999999996::DOUBLE) / den < 0.0001 THEN 0.0::DOUBLE ELSE (na * 0.8::DOUBLE + nc * 0.19999999999999996::DOUBLE) / den END AS s
  FROM (SELECT a.p AS p, b.p AS t, count(*) AS nc, CAST(sum(CASE WHEN b.rating >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS na FROM (SELECT rated.* FROM rated SEMI JOIN shown ON shown.u = rated.u AND shown.p = rated.p) a JOIN rated b ON a.u = b.u AND a.p <> b.p WHERE a.rating >= 3 AND b.rating >= 3 GROUP BY a.p, b.p) x
  LEFT JOIN (SELECT p, count(*) AS den FROM (SELECT rated.* FROM rated SEMI JOIN shown ON shown.u = rated.u AND shown.p = rated.p) WHERE rating >= 3 GROUP BY p) d ON d.p = x.p"""
STEPS["uti"], STEPS["pti"] = STEPS["ut"].replace("uus", "uui"), STEPS["pt"].replace("pps", "ppi")
STEPS["ubcfi_raw"] = STEPS["ubcf_raw"].replace("ut.", "uti.").replace("FROM ut ", "FROM uti ")
STEPS["popb_raw"] = STEPS["pop_raw"].replace("FROM pop WHERE", "FROM pop SEMI JOIN live ON live.p = pop.p WHERE")
STEPS["newest_raw"] = "SELECT users.u, top.p, s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2 FROM users, (SELECT p, CAST(epoch(date) AS DOUBLE) AS s0 FROM live ORDER BY date DESC, p DESC LIMIT 500) top"
STEPS["title_words"] = r"""SELECT p, list_distinct(regexp_extract_all(trim(translate(lower(regexp_replace(title, ' +', ' ', 'g')), chr(10) || chr(9) || '.,?!$"', '')), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+')) AS w FROM live"""


def based_on(lists: str, near: bool = False) -> str:
    """Scores of a product-based specialist over templates, with 30 asked for; near: templates near-identical to their base are left out."""
    apart = f"LEFT JOIN title_words wa ON wa.p = b.p LEFT JOIN title_words wb ON wb.p = {lists}.t WHERE coalesce(len(list_intersect(wa.w, wb.w)), 0) <= 2" if near else ""
    return f"""SELECT u, p, s[1] AS s0, s[2] AS s1, s[3] AS s2 FROM (SELECT u, p, max([CAST(CASE WHEN base_rank <= 5 THEN 20 ELSE 10 END * 30 - place + 1 AS DOUBLE), CAST(n_bases - base + 1 AS DOUBLE), s]) AS s FROM (
      SELECT x.u, x.t AS p, x.base_rank, x.s, n_bases, row_number() OVER (PARTITION BY x.u, x.base_rank ORDER BY x.place) AS place, dense_rank() OVER (PARTITION BY x.u ORDER BY x.base_rank) AS base
      FROM (SELECT b.u, b.base_rank, {lists}.t, {lists}.s, {lists}.place, n_bases FROM (SELECT *, count(*) OVER (PARTITION BY u) AS n_bases FROM bases) b JOIN {lists} ON {lists}.p = b.p {apart}) x
      ANTI JOIN blocked ON blocked.u = x.u AND blocked.p = x.t) GROUP BY u, p)"""


STEPS["pbcf_raw"], STEPS["pbcfi_raw"], STEPS["cb_raw"], STEPS["cbn_raw"] = based_on("pt"), based_on("pti"), based_on("ct"), based_on("ct", True)


def listed(raw: str, name: str, impressions: bool = False, most: int = 60) -> str:
    """The first of each user after blocking, age, boost and, with impressions, history, as merges get them."""
    f = "* age * 1.0::DOUBLE * 1.0::DOUBLE * coalesce(in_boost, 1.0::DOUBLE)"
    history = "LEFT JOIN shown ON shown.u = r.u AND shown.p = r.p WHERE coalesce(n, 0) < 2" if impressions else ""
    return f"""SELECT * FROM (SELECT u, '{name}' AS algorithm, p, row_number() OVER (PARTITION BY u ORDER BY s0 DESC, s1 DESC, s2 DESC, p DESC) AS rank, s0, s1, s2 FROM (
      SELECT r.u, r.p, r.s0 {f} AS s0, r.s1 {f} AS s1, r.s2 {f} AS s2 FROM {raw} r ANTI JOIN blocked ON blocked.u = r.u AND blocked.p = r.p JOIN model ON model.p = r.p LEFT JOIN boosts ON boosts.u = r.u AND boosts.p = r.p {history})) WHERE rank <= {most}"""


def recommended(raw: str) -> str:
    return f"""SELECT u AS "user", CAST(rank AS INTEGER) AS rank, p AS product, round(s0, 6) AS score_1, round(s1, 6) AS score_2, round(s2, 6) AS score_3 FROM ({listed(raw, '', most=10)})"""


def all_lists(*raws: str, impressions: bool = False) -> str:
    return " UNION ALL ".join(listed(r, a, impressions) for r, a in zip(raws, ("UBCF", "PBCF", "CB", "POP")))


STEPS["lists"] = all_lists("ubcf_raw", "pbcf_raw", "cbn_raw", "pop_raw")
STEPS["listsb"] = all_lists("ubcf_raw", "pbcf_raw", "cbn_raw", "popb_raw")
STEPS["listsi"] = all_lists("ubcfi_raw", "pbcfi_raw", "cbn_raw", "pop_raw", impressions=True)


def arrays(lists: str) -> str:
    column = lambda k, a: f"coalesce(list(p ORDER BY rank) FILTER (WHERE algorithm = '{a}'), CAST([] AS VARCHAR[])) AS l{k}"
    return f"SELECT u, {', '.join(column(k, a) for k, a in enumerate(('UBCF', 'PBCF', 'CB')))} FROM {lists} GROUP BY u"


def left(k: int) -> str:
    return f"list_filter(l{k}, lambda x: NOT list_contains(ps, x))"


def dealt(arrays: str) -> str:
    """HRChunks, turn by turn: one, one and two items."""
    return f"""SELECT u, 0 AS k, CAST([] AS VARCHAR[]) AS ps, CAST([] AS VARCHAR[]) AS ts FROM {arrays} UNION ALL SELECT u, k + 1, ps || items, ts || list_transform(items, lambda x: tag) FROM (
      SELECT u, k, ps, ts, CASE k % 3 WHEN 0 THEN 'UBCF' WHEN 1 THEN 'PBCF' ELSE 'CB' END AS tag, list_slice(CASE k % 3 WHEN 0 THEN {left(0)} WHEN 1 THEN {left(1)} ELSE {left(2)} END, 1, CASE k % 3 WHEN 2 THEN 2 ELSE 1 END) AS items
      FROM self JOIN {arrays} USING (u) WHERE k < 90 AND len(ps) < 30)"""


STEPS["arrs"], STEPS["arrsb"] = arrays("lists"), arrays("listsb")
STEPS["chunk_turns"] = dealt("arrs").replace("self", "chunk_turns")
STEPS["chunkb_turns"] = dealt("arrsb").replace("self", "chunkb_turns")
#: HRRandom, draw by draw: the dice are the first 32 bits of the MD5 hash of seed, user and draw.
STEPS["random_turns"] = f"""SELECT u, 0 AS k, CAST([] AS VARCHAR[]) AS ps, CAST([] AS VARCHAR[]) AS ts FROM arrs UNION ALL SELECT u, k + 1, CASE c WHEN 0 THEN ps || [n0] WHEN 1 THEN ps || [n1] WHEN 2 THEN ps || [n2] ELSE ps END, CASE c WHEN 0 THEN ts || ['UBCF'] WHEN 1 THEN ts || ['PBCF'] WHEN 2 THEN ts || ['CB'] ELSE ts END FROM (
  SELECT *, CASE WHEN w0 > roll THEN 0 WHEN w0 + w1 > roll THEN 1 WHEN w0 + w1 + w2 > roll THEN 2 END AS c FROM (SELECT *, dice / 4294967296.0::DOUBLE * (w0 + w1 + w2) AS roll FROM (
  SELECT *, CASE WHEN n0 IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS w0, CASE WHEN n1 IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS w1, CASE WHEN n2 IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS w2 FROM (
  SELECT u, k, ps, ts, CAST('0x' || substr(md5('17/' || u || '/' || (k + 1)), 1, 8) AS BIGINT) AS dice, {left(0)}[1] AS n0, {left(1)}[1] AS n1, {left(2)}[1] AS n2 FROM random_turns JOIN arrs USING (u) WHERE k < 30))))"""


def taken(turns: str, lists: str) -> str:
    return f"""SELECT x.u, place, x.p, s0, s1, s2, tag FROM (SELECT u, unnest(range(1, len(ps) + 1)) AS place, unnest(ps) AS p, unnest(ts) AS tag FROM (SELECT u, arg_max(ps, k) AS ps, arg_max(ts, k) AS ts FROM {turns} GROUP BY u)) x
      JOIN {lists} l ON l.u = x.u AND l.p = x.p AND l.algorithm = x.tag"""


def voted(lists: str) -> str:
    """HRVoting: by votes, with the next item of PBCF before every eighth."""
    return f"""SELECT u, place, p, s0, s1, s2, CAST(total - place + 1 AS VARCHAR) AS tag FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY k, part) AS place FROM (SELECT *, row_number() OVER (PARTITION BY u, p ORDER BY k, part) AS first FROM (
      SELECT *, coalesce(max(CASE WHEN part = 1 THEN k END) OVER (PARTITION BY u) + 1, 0) AS total FROM (
      SELECT * FROM (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY votes DESC, p DESC) - 1 AS k, 1 AS part, votes AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2 FROM (
        SELECT u, p, round(sum(CASE algorithm WHEN 'CB' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * 1000 * pow(2.0::DOUBLE, -(rank - 1) / 4.0::DOUBLE)), 9) AS votes FROM {lists} WHERE rank <= 30 AND algorithm <> 'POP' GROUP BY u, p)) WHERE k < 30
      UNION ALL SELECT u, p, 8 * (rank - 1) AS k, 0 AS part, s0, s1, s2 FROM {lists} WHERE algorithm = 'PBCF')) WHERE k < total) WHERE first = 1)"""


def finished(merged: str, lists: str, padded: bool = False) -> str:
    """Filled from POP, cut at 20 (and padded to 20), near-identical titles last, the first ten."""
    rows = f"""SELECT u, rank, p, s0, s1, s2, tag FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY part, place) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY u, p ORDER BY part, place) AS first FROM (
      SELECT u, place, p, s0, s1, s2, tag, 0 AS part FROM ({merged}) UNION ALL SELECT u, rank, p, s0, s1, s2, 'POP', 1 FROM {lists} WHERE algorithm = 'POP')) WHERE first = 1) WHERE rank <= 20"""
    if padded:
        pool = "SELECT p, row_number() OVER (ORDER BY h, p) AS k FROM (SELECT p, CAST('0x' || substr(md5('17/' || p), 1, 8) AS BIGINT) AS h FROM live) ORDER BY k LIMIT 20"
        rows = f"""SELECT * FROM ({rows}) UNION ALL SELECT u, n + place, p, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 'PRE-FILTER' FROM (SELECT s.u, n, pool.p, row_number() OVER (PARTITION BY s.u ORDER BY k) AS place
          FROM (SELECT users.u, count(r.p) AS n FROM users LEFT JOIN ({rows}) r ON r.u = users.u GROUP BY users.u HAVING count(r.p) < 20) s, ({pool}) pool ANTI JOIN ({rows}) r ON r.u = s.u AND r.p = pool.p) WHERE n + place <= 20"""
    return f"""SELECT u AS "user", CAST(place AS INTEGER) AS rank, p AS product, round(s0, 6) AS score_1, round(s1, 6) AS score_2, round(s2, 6) AS score_3, CASE WHEN near THEN 'NI,' || tag ELSE tag END AS tags FROM (
      SELECT *, row_number() OVER (PARTITION BY u ORDER BY near, rank) AS place FROM (SELECT f.*, EXISTS (SELECT 1 FROM finals h JOIN title_words a ON a.p = h.p JOIN title_words b ON b.p = f.p WHERE h.u = f.u AND h.rank < f.rank AND f.rank - h.rank <= 10 AND len(list_intersect(a.w, b.w)) > 2) AS near
      FROM finals f)) WHERE place <= 10""", rows


#: Hybrids by query name: what is merged, of which lists, padded or not.
HYBRIDS = {
    "hybrid_chunks": (taken("chunk_turns", "lists"), "lists", False),
    "hybrid_random": (taken("random_turns", "lists"), "lists", False),
    "hybrid_voting": (voted("lists"), "lists", False),
    "hybrid_voting_impressions": (voted("listsi"), "listsi", False),
    "hybrid_chunks_before_scoring": (taken("chunkb_turns", "listsb"), "listsb", True),
}


def steps_of(select: str, more: dict[str, str]) -> list[str]:
    """The steps that select names, and those that these name, in order."""
    known, need, todo = STEPS | more, set(), [select]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        for name in words & set(known) - need:
            need.add(name)
            todo.append(known[name])
    return [f"{name} AS ({body})" for name, body in known.items() if name in need]


def sql(select: str, **more: str) -> str:
    """select after its steps."""
    steps = steps_of(select, more)
    return f"WITH RECURSIVE {', '.join(steps)} {select}" if steps else select


#: English stop words as Spark ML lists them, and words of web pages.
STOP_WORDS = """
a about above after again against all am amp an and any are aren't as at be because been before being below between both but by can can't cannot could
couldn't did didn't do does doesn't doing don don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
her here here's hers herself him himself his how how's href http i i'd i'll i'm i've if in into is isn't it it's its itself just let's me more most
mustn't my myself no nor not now of off on once only or other ought our ours ourselves out over own quot s same shan't she she'd she'll she's should
shouldn't so some such t than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those
through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom
why why's will with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
:// .&#
"""

DAY = "strftime({}, '%Y-%m-%d')"
#: Selects by query name.
SELECTS = {
    "scan_users": "SELECT DISTINCT u AS external_id FROM ev WHERE NOT anonymous",
    "scan_products": f"SELECT p AS external_id, category, price FROM product WHERE deleted_on IS NULL AND category IS NOT NULL AND date >= {PRESENT} - INTERVAL 20 DAY AND date <= {PRESENT}",
    "scan_deleted_products": "SELECT p AS external_id FROM product WHERE p IN ('p1', 'p16', 'p33', 'p34', 'p999999')",
    "scan_activity_summaries": f"SELECT u AS \"user\", p AS product, activity, {DAY.format('day')} AS day FROM summary WHERE u IN ('u0', 'u1', 'u2', 'hmrtmp9') AND activity IN ('purchase', 'click') AND day >= TIMESTAMP '2024-01-05 00:00:00'",
    "latest_activity_day": f"SELECT u AS \"user\", {DAY.format('max(day)')} AS day FROM summary GROUP BY u",
    "scan_impressions": "SELECT p AS p_id, u AS u_id, n AS count, epoch_us(first) AS first FROM shown WHERE p IN ('p1', 'p2', 'p3')",
    "impression_pairs": "SELECT DISTINCT u AS u_id, p AS p_id FROM shown WHERE p IN ('p4', 'p5')",
    "date_filtered_products": f"SELECT p AS external_id FROM product WHERE date <= TIMESTAMP '2024-01-20 00:00:00' AND expiration_date >= TIMESTAMP '2024-01-20 00:00:00'",
    "table_counts": "SELECT 'users' AS name, (SELECT count(DISTINCT u) FROM ev WHERE NOT anonymous) AS n UNION ALL SELECT 'products', (SELECT count(*) FROM product) UNION ALL SELECT 'models', (SELECT count(*) FROM live)",
    "popular_products": "SELECT p AS p_id, round(popularity, 9) AS popularity FROM (SELECT * FROM pop WHERE latest >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY popularity DESC, p DESC LIMIT 20)",
    "raw_activities": "SELECT u AS \"user\", p AS product, activity, epoch_us(ts) AS created_at FROM act WHERE NOT anonymous AND activity IN ('purchase', 'signup') AND ts > TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'",
    "raw_impressions": "SELECT u AS \"user\", p AS product, event_id FROM imp WHERE event_id > 500 AND ts < TIMESTAMP '2024-01-20 00:00:00'",
    "anonymous_users": "SELECT DISTINCT u AS \"user\" FROM ev WHERE starts_with(u, 'hmrtmp')",
    "activity_summary": f"SELECT u AS \"user\", p AS product, activity, {DAY.format('day')} AS day, epoch_us(ts) AS created_at FROM summary",
    "impression_summary": "SELECT u AS u_id, p AS p_id, n AS count, epoch_us(first) AS first FROM shown",
    "popularity_summary": f"SELECT p AS p_id, {DAY.format('first')} AS first, {DAY.format('latest')} AS latest, n AS count, round(popularity, 9) AS popularity FROM pop",
    "popularity": "SELECT p AS p_id, CAST(row_number() OVER (ORDER BY popularity DESC, p DESC) AS INTEGER) AS rank, n AS count, round(popularity, 9) AS popularity FROM pop ORDER BY rank LIMIT 10",
    "rating_histogram": "SELECT rating, count(*) AS n FROM rated GROUP BY rating",
    "products_by_rating": "SELECT u AS \"user\", rating, count(*) AS n, min(p) AS first, max(p) AS last FROM rated GROUP BY u, rating",
    "users_by_rating": "SELECT p AS product, rating, count(*) AS n, min(u) AS first, max(u) AS last FROM rated GROUP BY p, rating",
    "uu_strengths": 'SELECT u AS "user", t AS template_user, nc, na, CAST(den AS BIGINT) AS denominator, round(s, 9) AS strength FROM uus',
    "pp_strengths": "SELECT p AS product, t AS template_product, nc, na, CAST(den AS BIGINT) AS denominator, round(s, 9) AS strength FROM pps",
    "uu_strengths_impressions": 'SELECT u AS "user", t AS template_user, nc, na, den AS denominator, round(s, 9) AS strength FROM uui',
    "pp_strengths_impressions": "SELECT p AS product, t AS template_product, nc, na, den AS denominator, round(s, 9) AS strength FROM ppi",
    "user_templates": 'SELECT u AS "user", CAST(place AS INTEGER) AS place, t AS template_user, round(s, 9) AS strength FROM ut',
    "product_templates": "SELECT p AS product, CAST(place AS INTEGER) AS place, t AS template_product, round(s, 9) AS strength FROM pt",
    "allowed_product_templates": f"""SELECT p AS product, CAST(place AS INTEGER) AS place, t AS template_product, round(s, 9) AS strength FROM (SELECT pps.p, t, s, row_number() OVER (PARTITION BY pps.p ORDER BY s DESC, t) AS place FROM pps
      JOIN product q ON q.p = pps.t AND q.date <= {PRESENT} AND q.expiration_date >= {PRESENT} WHERE s > 0 AND t NOT IN ('p1', 'p2')) WHERE place <= 150""",
    "recent_activities": f"SELECT u AS \"user\", p AS product, activity, {DAY.format('day')} AS day FROM recent",
    "recent_products": 'SELECT u AS "user", CAST(base_rank AS INTEGER) AS base_rank, p AS product FROM bases',
    "template_activities": 'SELECT t AS "user", p AS product, out_boost FROM lent',
    "blocked_products": 'SELECT u AS "user", p AS product FROM blocked',
    "decays": "SELECT CAST(x AS BIGINT) AS x, round(1 - least(x, 7) / 7.0::DOUBLE, 9) AS linear, round(1 / (x + 1.0::DOUBLE), 9) AS rational, round(pow(2.0::DOUBLE, -x / 3.0::DOUBLE), 9) AS exponential, CASE WHEN x < 3 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS step FROM (SELECT event_id % 30 AS x FROM events GROUP BY 1)",
    "whole_days": f"SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '2024-01-15 12:30:00') - epoch_us(ts)) / 86400000000.0) AS BIGINT) AS days FROM events",
    "similarities": """SELECT a.p_partkey AS a, b.p_partkey AS b, round(CASE WHEN a.p_retailprice = 0 AND b.p_retailprice = 0 THEN 1 ELSE least(a.p_retailprice, b.p_retailprice) / greatest(a.p_retailprice, b.p_retailprice) END, 9) AS numeric, CASE WHEN a.p_brand = b.p_brand THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fixed,
      round(pow(2.0::DOUBLE, -abs(a.p_size - b.p_size) / 2.0::DOUBLE), 9) AS date FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
    "tokens": r"""SELECT p AS external_id, CAST(len(w) AS BIGINT) AS n, w[1] AS first, w[-1] AS last FROM (SELECT p, regexp_extract_all(trim(translate(lower(regexp_replace(full_content, ' +', ' ', 'g')), chr(10) || chr(9) || '.,?!$"', '')), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS w FROM live)""",
    "term_frequencies": "SELECT p AS product, attribute, term, n AS count FROM tf",
    "document_frequencies": "SELECT language, term, CAST(df AS BIGINT) AS df FROM df",
    "tfidf": "SELECT p AS product, attribute, term, round(w, 9) AS tfidf FROM tfidf",
    "content_strengths": "SELECT p AS product, t AS template_product, round(s, 6) AS strength FROM content",
    "content_templates": "SELECT p AS product, CAST(place AS INTEGER) AS place, t AS template_product, round(s, 9) AS strength FROM ct",
    "recommend_pop": recommended("pop_raw"),
    "recommend_ubcf": recommended("ubcf_raw"),
    "recommend_pbcf": recommended("pbcf_raw"),
    "recommend_cb": recommended("cb_raw"),
    "recommend_random": """SELECT u AS "user", CAST(k + 1 AS INTEGER) AS rank, p AS product, round(s, 6) AS score_1, 0.0::DOUBLE AS score_2, 0.0::DOUBLE AS score_3 FROM (SELECT u, p, s, row_number() OVER (PARTITION BY u ORDER BY s DESC, p DESC) - 1 AS k FROM (
      SELECT r.u, r.p, (1 - (row_number() OVER (PARTITION BY r.u ORDER BY k) - 1) / 29.0::DOUBLE) * age * 1.0::DOUBLE * 1.0::DOUBLE * coalesce(in_boost, 1.0::DOUBLE) AS s, row_number() OVER (PARTITION BY r.u ORDER BY k) AS nth, n FROM (
        SELECT users.u, ring.p, (ring.position - start + n) % n AS k, n FROM (SELECT u, CAST('0x' || substr(md5('17/' || u), 1, 8) AS BIGINT) AS h FROM users) users JOIN (SELECT p, row_number() OVER (ORDER BY h % 256, h, p) - 1 AS position, count(*) OVER () AS n FROM (SELECT p, CAST('0x' || substr(md5('17/' || p), 1, 8) AS BIGINT) AS h FROM product WHERE deleted_on IS NULL)) ring ON TRUE, LATERAL (SELECT users.h % ring.n AS start)) r
      ANTI JOIN blocked ON blocked.u = r.u AND blocked.p = r.p JOIN model ON model.p = r.p LEFT JOIN boosts ON boosts.u = r.u AND boosts.p = r.p WHERE k < 1000) WHERE nth <= 500) WHERE k < 10""",
    "sample_users": "SELECT external_id FROM (SELECT DISTINCT u AS external_id FROM ev) ORDER BY CAST('0x' || substr(md5('5/' || external_id), 1, 8) AS BIGINT), external_id LIMIT 10",
    "scan_models": "SELECT p AS external_id, category, coalesce(price, 100) AS price FROM live",
    "models_sharing_terms": "SELECT DISTINCT p AS external_id FROM tfidf WHERE attribute = 'full_content' AND language = 'x-en' AND term IN ('the', 'of', 'and')",
    "scan_uu_strengths": "SELECT u AS \"user\", t AS template_user, nc, na, CAST(den AS BIGINT) AS denominator, round(s, 9) AS strength FROM uus WHERE u IN ('u1', 'u2', 'u3') AND s > 0",
    "scan_pp_strengths": "SELECT p AS product, t AS template_product, nc, na, CAST(den AS BIGINT) AS denominator, round(s, 9) AS strength FROM pps WHERE t IN ('p1', 'p2') AND s > 0",
    "scan_content_strengths": "SELECT p AS product, t AS template_product, round(s, 6) AS strength FROM content WHERE p IN ('p1', 'p2')",
    "scan_uu_operands": "SELECT u AS \"user\", t AS template_user, nc, na, CAST(den AS BIGINT) AS denominator FROM uus WHERE u IN ('u1', 'u2')",
    "scan_pp_operands": "SELECT p AS product, t AS template_product, nc, na, CAST(den AS BIGINT) AS denominator FROM pps WHERE p = 'p5'",
    "scan_document_frequency": "SELECT term, CAST(coalesce(df, 0) AS BIGINT) AS df FROM (VALUES ('the'), ('and'), ('nowhere')) t(term) LEFT JOIN (SELECT * FROM df WHERE language = 'x-en') d USING (term)",
    "scan_templates": "SELECT u AS id, CAST(place AS INTEGER) AS place, t AS template, round(s, 9) AS strength FROM ut WHERE u IN ('u1', 'u2', 'u10')",
    "latest_runs": "SELECT * FROM (VALUES ('a', 'success', '2024-01-10', 'p7'), ('b', 'failed', '2024-01-10', 'p7'), ('c', 'running', '2024-01-10', 'p7')) t(type, status, cutoff, latest)",
    "csv_round_trip": "SELECT p AS entity, t AS template, round(s, 9) AS strength FROM pps",
    "upsert_templates": "SELECT u AS id, count(*) AS n, round(max(s), 9) AS first FROM ut WHERE u <> 'u1' AND u <> 'new' GROUP BY u UNION ALL SELECT 'u1', 1, 0.5::DOUBLE UNION ALL SELECT 'new', 2, 0.25::DOUBLE",
    "store_swap": """SELECT 'staged' AS name, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM pop UNION ALL SELECT 'published', count(*), CAST(sum(n) AS BIGINT) FROM pop WHERE n % 2 = 0 UNION ALL
      SELECT 'appended', count(*) + count(*) FILTER (WHERE n % 2 = 0), CAST(sum(n) + sum(n) FILTER (WHERE n % 2 = 0) AS BIGINT) FROM pop UNION ALL SELECT 'merged', count(*) + 1, CAST(sum(n) FILTER (WHERE n % 2 <> 0) + 7 AS BIGINT) FROM pop""",
    "add_frequencies": "SELECT language, term, CAST(df AS BIGINT) AS df FROM df",
    "save_marks": "SELECT u AS \"user\", p AS product, CASE WHEN activity = 'purchase' THEN activity END AS pp_latest_type, CASE WHEN activity = 'purchase' THEN CAST(epoch_us(ts) AS VARCHAR) END AS pp_latest_date FROM summary",
    "distinct_sample": "SELECT DISTINCT p AS product FROM summary ORDER BY p LIMIT 25",
    "stop_words": r"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(k) AS BIGINT) AS kept, array_to_string(k, ' ') AS words FROM (SELECT doc_id, w, list_filter(w, lambda x: NOT list_contains(STOP_LIST, x) AND length(x) BETWEEN 3 AND 30) AS k FROM (
      SELECT doc_id, regexp_extract_all(trim(translate(lower(regexp_replace(text, ' +', ' ', 'g')), chr(10) || chr(9) || '.,?!$"', '')), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+') AS w FROM documents WHERE lang = 'en' AND text IS NOT NULL))""".replace("STOP_LIST", "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS.split()) + "]"),
    "parsed_dates": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS at, CASE WHEN event_id % 5 <> 0 THEN CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) + 1 AS BIGINT) END AS days FROM events",
    "list_similarities": "SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(x)), 9) AS list FROM (SELECT a.doc_id AS a, b.doc_id AS b, string_split(coalesce(a.text, ''), ' ')[1:12] AS x, string_split(coalesce(b.text, ''), ' ')[1:12] AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)",
    "flat_and_nested": "SELECT p_partkey, p_name AS about_p_name, p_size AS about_more_p_size, p_type AS about_more_p_type FROM part",
    "updated_products": "SELECT 'terms' AS kind, p AS external_id FROM product WHERE date >= TIMESTAMP '2024-01-20 00:00:00' UNION ALL SELECT 'never', p FROM product",
    "registered_specialist": recommended("newest_raw"),
    "bloom_false_positives": "SELECT TRUE AS as_expected, TRUE AS below_one",
    "streaming_delete": """SELECT p AS product, CAST(place AS INTEGER) AS place, t AS template_product, round(s, 9) AS strength FROM (SELECT p, t, s, row_number() OVER (PARTITION BY p ORDER BY s DESC, t) AS place FROM pps WHERE s > 0 AND p NOT IN ('p3', 'p4', 'p50') AND t NOT IN ('p3', 'p4', 'p50')) WHERE place <= 150""",
    "streaming_user_templates": 'SELECT u AS "user", CAST(place AS INTEGER) AS place, t AS template_user, round(s, 9) AS strength FROM ut',
    "streaming_expiry": f"""SELECT u AS "user", p AS product, max({{'t': ts, 'a': activity}}).a AS activity, {DAY.format("date_trunc('day', max(ts))")} AS day, epoch_us(max(ts)) AS created_at FROM act WHERE NOT starts_with(u, 'hmrtmp') OR ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY u, p""",
    "voting_scores": f"""SELECT u AS "user", p AS product, round(round(sum(CASE algorithm WHEN 'CB' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * 1000 * pow(2.0::DOUBLE, -(rank - 1) / 4.0::DOUBLE)), 9), 6) AS votes FROM ({listed('ubcf_raw', 'UBCF')} UNION ALL {listed('pbcf_raw', 'PBCF')} UNION ALL {listed('cb_raw', 'CB')}) WHERE rank <= 30 GROUP BY u, p""",
    "context_filter": f"SELECT p AS external_id FROM live WHERE (language = 'x-en' AND coalesce(price, 100) < 1500) OR (language <> 'x-en' AND date >= {PRESENT} - INTERVAL 10 DAY)",
    "context_filter_list": "SELECT p AS external_id FROM live WHERE source = 'src3' AND coalesce(price, 100) >= 100",
    "merge_operands": """SELECT coalesce(n.p, d.p, s.p) AS entity, coalesce(n.t, d.t, s.t) AS template, CAST(nc AS DOUBLE) AS nc, CAST(na AS DOUBLE) AS na, CAST(den AS DOUBLE) AS denominator, round(s, 9) AS strength FROM (SELECT p, t, nc, na FROM pps WHERE nc % 3 <> 0) n
      FULL JOIN (SELECT p, t, CAST(den AS BIGINT) AS den FROM pps WHERE nc % 3 <> 1) d ON n.p = d.p AND n.t = d.t FULL JOIN (SELECT p, t, s FROM pps WHERE nc % 3 <> 2) s ON coalesce(n.p, d.p) = s.p AND coalesce(n.t, d.t) = s.t""",
    "upsert_strengths": "SELECT p AS product, t AS template_product, CASE WHEN nc % 2 = 0 THEN 1.0::DOUBLE ELSE round(s, 9) END AS strength FROM pps",
    "increment_operands": "SELECT p AS product, t AS template_product, CAST(nc + CASE WHEN nc % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS nc, CAST(na + CASE WHEN nc % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS na FROM pps",
    "delete_products": "SELECT p AS external_id FROM product WHERE p NOT IN ('p3', 'p4')",
    "mark_deleted": "SELECT p AS external_id, strftime(CASE WHEN p IN ('p3', 'p16') THEN coalesce(deleted_on, TIMESTAMP '2024-01-30 00:00:00') ELSE deleted_on END, '%Y-%m-%d') AS deleted_on FROM product",
    "copy_marks": "SELECT u AS \"user\", p AS product, CASE WHEN day >= TIMESTAMP '2024-01-15 00:00:00' THEN activity END AS uu_latest_type, CASE WHEN day >= TIMESTAMP '2024-01-15 00:00:00' THEN CAST(epoch_us(ts) AS VARCHAR) END AS uu_latest_date FROM summary",
    "expire_anonymous": "SELECT u AS \"user\", p AS product, epoch_us(ts) AS created_at FROM act WHERE NOT anonymous OR ts >= TIMESTAMP '2024-01-15 00:00:00'",
    "common_terms": "SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(list_intersect(string_split(a.text, ' '), string_split(b.text, ' '))) AS BIGINT) AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1",
    "bloom_filter": "SELECT count(DISTINCT user_id) AS members, CAST(0 AS BIGINT) AS missed FROM events",
    "near_identical": """SELECT DISTINCT lo.lang AS "user", 'p' || lo.doc_id AS product FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, string_split(text, ' ') AS w FROM documents) lo
      JOIN (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, string_split(text, ' ') AS w FROM documents) hi ON hi.lang = lo.lang AND hi.r < lo.r AND lo.r - hi.r <= 10 WHERE len(list_intersect(lo.w, hi.w)) > 40""",
}
#: Streaming runs end where a batch run does.
SELECTS["streaming_activity_summary"] = SELECTS["activity_summary"]
SELECTS["streaming_impression_summary"] = SELECTS["impression_summary"]
SELECTS["streaming_popularity"] = SELECTS["popularity_summary"]
SELECTS["streaming_uu_strengths"] = SELECTS["uu_strengths"]
SELECTS["streaming_pp_strengths"] = SELECTS["pp_strengths"]
SELECTS["streaming_terms"] = SELECTS["term_frequencies"]
SELECTS["sparse_popularity"] = """SELECT 'p' || l_partkey AS p_id, count(DISTINCT o_custkey) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey"""


def hybrid(name: str) -> str:
    select, rows = finished(*HYBRIDS[name])
    return sql(select, finals=rows)


def oracle_sql() -> dict[str, str]:
    found = {name: sql(select) for name, select in SELECTS.items()} | {name: hybrid(name) for name in HYBRIDS}
    wide = ", ".join(f"max(CASE WHEN rank = {k} THEN product END) AS PRODUCT_{k}" for k in range(1, 11))
    found["batch_recommend"] = f'SELECT "user" AS "USER", {wide} FROM ({found["hybrid_voting"]}) GROUP BY "user"'
    return found
