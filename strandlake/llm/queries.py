"""Registered queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from .collocations import op12
from .decontaminate import op4
from .html_extract import op7
from .minhash import op10
from .packing import op1
from .runs import op11
from .sharding import op13
from .substring_dedup import op9
from .suffix_dedup import op3
from .syncmers import op6
from .toxicity import op8
from .url_rules import op2
from .wavelet import op5

QUERIES = {
    "op1_packing": op1,
    "op2_url_rules": op2,
    "op3_suffix_array": op3,
    "op4_decontamination": op4,
    "op5_wavelet_matrix": op5,
    "op6_syncmers": op6,
    "op7_html_wrappers": op7,
    "op8_toxicity": op8,
    "op9_substring_dedup": op9,
    "op10_minhash": op10,
    "op11_grammar_runs": op11,
    "op12_collocations": op12,
    "op13_prefix_shards": op13,
}

ORACLES: dict[str, str] = {
    "op12_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
        q AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM q, range(1, 5) r(k) WHERE len(ws) >= k) u),
        f AS (SELECT lang, k, array_to_string(g, ' ') AS p, any_value(g) AS g, count(*) AS f FROM g GROUP BY lang, k, p HAVING f >= 30),
        n AS (SELECT lang, sum(len(ws)) AS n FROM q GROUP BY lang),
        c AS (SELECT lang, k, p, g, f AS a FROM f WHERE k > 1),
        cuts AS (SELECT *, array_to_string(g[1:cut], ' ') AS pl, array_to_string(g[cut + 1:], ' ') AS pr FROM (SELECT lang, k, p, g, a, unnest(range(1, k)) AS cut FROM c) u),
        s AS (SELECT cuts.lang, cuts.p, a, cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
              FROM cuts JOIN f l ON l.lang = cuts.lang AND l.p = cuts.pl JOIN f r ON r.lang = cuts.lang AND r.p = cuts.pr),
        best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
        inside AS (SELECT lang, a, array_to_string(g[i:i + m - 1], ' ') AS p FROM (SELECT lang, g, k, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) r(m) WHERE m < k) u),
        longer AS (SELECT lang, p, max(a) AS longer FROM inside GROUP BY ALL),
        kept AS (SELECT best.*, best.p AS phrase FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.p = best.p WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000""",
    # crc32 byte by byte, with its table built from the polynomial
    "op13_prefix_shards": r"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
        d AS (SELECT doc_id, strlen(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, CAST(b + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(b), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, x: xor(crc[xor(c & 255, x) + 1], c >> 8)), 4294967295) AS text_crc32 FROM d, t),
        s AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS start, sum(size) OVER () AS total FROM c),
        p AS (SELECT *, CAST(((2 * start + size) * 8) // (2 * total) AS INTEGER) AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35) u),
        st AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
        words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
        marked AS (SELECT words.doc_id, p, x, max(CASE WHEN st.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
                   FROM words LEFT JOIN st ON st.doc_id = words.doc_id AND st.i = words.p)
        SELECT w.doc_id, CAST(count(p) AS BIGINT) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256
        FROM w LEFT JOIN marked ON marked.doc_id = w.doc_id GROUP BY w.doc_id""",
    "op10_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0) u),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        links AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL) p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) c ON c.x = d.doc_id""",
}
