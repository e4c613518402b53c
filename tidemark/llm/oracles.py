"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from tidemark.llm.quality import END, GAMMA, MEASURES, PRIOR, SHARES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS bucket FROM v" for m in MEASURES)
    shares = ", ".join(f"CASE WHEN n_words > 0 THEN ceil(greatest(0.0::double, sqrt({MEASURES[m][0]}) - 1) / sqrt({MEASURES[m][1].replace('_n_lines', 'nl')}) * {END})::int END AS {m}" for m in SHARES)
    buckets = f"{shares}, CASE WHEN n_words > 0 THEN ceil(ln(word_chars::double / n_words::double) / ln({GAMMA}::double))::int END AS word_length"
    quart = ", ".join(f"(min(bucket) FILTER (4 * upto >= {k} * total))::double AS q{k}" for k in (1, 3))

    def level(name: str, keys: str) -> str:
        group = f"{keys}, measure" if keys else "measure"
        return f"""{name} AS (SELECT {group}, max(total) AS n, {quart} FROM (
            SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY {group}) AS total
            FROM (SELECT {group}, bucket, count(*) AS n FROM l WHERE bucket IS NOT NULL GROUP BY ALL)) GROUP BY {group})"""

    def drawn(q: str) -> str:
        parent = f"(b.n * b.{q} + {PRIOR}::double * t.{q}) / (b.n + {PRIOR}::double)"
        return f"(a.n * a.{q} + {PRIOR}::double * ({parent})) / (a.n + {PRIOR}::double) AS {q}"

    out = " OR ".join(f"coalesce(bool_or(f.measure = '{m}' AND (v.{m} > f.high{f' OR v.{m} < f.low' if both else ''})), false)" for m, (*_, both) in MEASURES.items())
    return f"""
    WITH w AS (SELECT doc_id, lang, source, {_WORDS} AS w, coalesce(text, '') AS text,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln, row_number() OVER () AS rid FROM documents),
    win AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
    rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
    c AS (SELECT rid, doc_id, lang, source, len(w)::bigint AS n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0)::bigint AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols, (len(ln) - len(list_distinct(ln)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, len(ln) AS nl
          FROM w LEFT JOIN rep USING (rid)),
    v AS (SELECT *, {buckets} FROM c),
    l AS ({rows}),
    {level("a", "lang, source")}, {level("b", "lang")}, {level("t", "")},
    f0 AS (SELECT a.lang, a.source, a.measure, {drawn("q1")}, {drawn("q3")},
                  CASE a.measure {" ".join(f"WHEN '{m}' THEN {v[2]}::double" for m, v in MEASURES.items())} END AS spread, CASE a.measure {" ".join(f"WHEN '{m}' THEN {v[3]}::double" for m, v in MEASURES.items())} END AS least
           FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN t ON a.measure = t.measure),
    f1 AS (SELECT *, spread * greatest(q3 - q1, least) AS far, {END}::double - q3 AS way FROM f0),
    f AS (SELECT lang, source, measure, q1 - far AS low, CASE WHEN measure = 'word_length' THEN q3 + far WHEN way > 0 THEN q3 + way * (1 - exp(-far / way)) ELSE {END}::double END AS high FROM f1),
    o AS (SELECT v.rid, {out} AS broken FROM v LEFT JOIN f ON v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source GROUP BY v.rid)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT broken AS kept
    FROM v JOIN o USING (rid)"""


_ARCHIVE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::bigint AS n FROM pages),
    g AS (SELECT html, max(page_id) AS origin, count(*) AS k FROM p WHERE n >= 1000 GROUP BY html HAVING count(*) > 1)
    SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
           CASE WHEN origin IS NOT NULL AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> origin THEN origin END AS refers_to
    FROM p LEFT JOIN g ON p.html = g.html"""

_MIX = f"""
    WITH d AS (SELECT doc_id, source, len({_WORDS})::bigint AS size, md5(concat('mix', coalesce(doc_id::varchar, concat('text ', coalesce(text, ''))))) AS k FROM documents),
    s AS (SELECT source, sum(size)::bigint AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::int]::double AS w,
                 row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
    c AS (SELECT *, source_size * 2.0::double AS cap, sum(source_size) OVER () * 1.5::double AS total FROM s),
    l AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
          FROM c WINDOW o AS (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least(cap, (SELECT arg_min(lev, (cap / w, pos)) FROM l WHERE lev * w <= cap) * w) AS target FROM l),
    g AS (SELECT source, k, size, count(*) AS m FROM d GROUP BY ALL),
    r AS (SELECT g.*, t.source_size, t.target, coalesce(sum(size * m) OVER (PARTITION BY g.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
          FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole FROM r)
    SELECT d.doc_id, d.size, source_size, target, (whole * d.size + greatest(0, least(d.size, (floor(target)::bigint - whole * source_size - before) // m)))::bigint AS taken
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.k = e.k AND d.size = e.size"""

_CHAT = """
    WITH t AS (SELECT conv_id, row_number() OVER o AS place, count(*) OVER (PARTITION BY conv_id) AS n, role, text,
                      '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said
               FROM conversations WHERE conv_id IS NOT NULL WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)),
    p AS (SELECT conv_id, place, n, list((role, text)) OVER w AS k, string_agg(said, '') OVER w AS text FROM t
          WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT k, place, min(conv_id) AS conv_id, count(*)::bigint AS n_logged, min(text) AS text FROM p WHERE place = n GROUP BY k, place)
    SELECT conv_id, place::bigint AS n_turns, n_logged, text FROM f ANTI JOIN (SELECT DISTINCT k FROM p WHERE place < n) x ON f.k = x.k"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"

_HARD = f"""
    WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label::bigint END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS x
               FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
    s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, {_DOT.format("a.x", "b.x")}::bigint AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor, p.id AS pos, p.score AS ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS place
          FROM p JOIN s ON p.anchor = s.anchor WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor AS anchor_id, pos AS positive_id, place::int AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE place <= 3"""


def _clusters(rounds: int = 3) -> str:
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < 16)",
    ]
    d = _DOT.format("list_transform(list_zip(v.x, c.x), lambda z: z[1] - z[2])", "list_transform(list_zip(v.x, c.x), lambda z: z[1] - z[2])")
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT rid, min(c) AS c, any_value(d) AS d FROM (SELECT v.rid, c.c, ({d})::bigint AS d, min(({d})::bigint) OVER (PARTITION BY v.rid) AS least FROM v, c{i} c) WHERE d = least GROUP BY rid)")
        if i < rounds:
            sums = "SELECT a.c, k, sum(v.x[k])::bigint AS s, count(*) AS n FROM a{0} a JOIN v USING (rid), (SELECT unnest(range(1, 65)) AS k) GROUP BY a.c, k"
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY k) AS x FROM ({sums.format(i)}) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c))")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, a.c::int AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON a.c = c.c"""


ORACLES = {"op1_quality_rules": _quality(), "op2_warc_archive": _ARCHIVE, "op3_source_mix": _MIX, "op7_chat_format": _CHAT, "op11_hard_negatives": _HARD, "op12_centroid_clusters": _clusters()}
