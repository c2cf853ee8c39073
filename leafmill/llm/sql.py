"""DuckDB SQL that gives the same rows as the queries of this subpackage, where SQL can.

Each is written from the contract, not from the operator's way of computing it: the line
dedup finds runs as islands on the diagonals of all pairs of equal lines, the archive
compares payloads directly, the quality rules read quartiles from the sorted values, the
manifest builds its trees level by level, divergence compares every pair of sources term by term.
"""

from __future__ import annotations

from leafmill.llm.divergence import MIN_DOCS as MIN_TERM_DOCS
from leafmill.llm.divergence import TOP_TERMS
from leafmill.llm.line_dedup import MIN_CHARS
from leafmill.llm.merkle import FANOUT, TAMPER_EVERY
from leafmill.llm.quality_rules import MIN_DOCS, RATIOS, SPREAD_FACTOR
from leafmill.llm.warc import MIN_REVISIT

_BLANK = r"[\x20\x09-\x0D]+"
_WORDY = r"[^\x20\x09-\x0D]"

_STATS = rf"""
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang,
          coalesce(source, '') AS source FROM documents),
    w AS (SELECT r, list_filter(string_split_regex(t, '{_BLANK}'), lambda x: x <> '') AS ws,
          list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDY}')) AS ls FROM d),
    g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) u(i)),
    twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    s AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words,
          length(regexp_replace(t, '{_BLANK}', '', 'g')) AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls)::BIGINT AS n_lines,
          (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
          length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
          length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim, length(t) AS n_chars
          FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)"""


def _quality_rules() -> str:
    ratio = {k: f"({scale} * {top}) // greatest({below}, 1)" for k, (top, below, scale, _, _) in RATIOS.items()}
    values = " UNION ALL ".join(
        f"SELECT r, lang, source, '{k}' AS ratio, {spread} AS spread, {ratio[k]} AS v FROM b WHERE NOT base_failed"
        for k, (_, _, _, spread, _) in RATIOS.items()
    )
    # A value's sketch cell keeps its six leading bits.
    cell = "(v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0)"
    quartiles = lambda keys: f"""SELECT {keys}, ratio, count(*) AS docs, max(spread) AS spread,
        list_sort(list(c))[((count(*) + 3) // 4)::BIGINT] AS q25, list_sort(list(c))[((3 * count(*) + 3) // 4)::BIGINT] AS q75
        FROM cells GROUP BY ALL"""  # noqa: E731
    fence = lambda q: f"{q}.q25 - {SPREAD_FACTOR} * greatest({q}.q75 - {q}.q25, {q}.spread)", lambda q: (
        f"{q}.q75 + {SPREAD_FACTOR} * greatest({q}.q75 - {q}.q25, {q}.spread)"
    )
    pick = lambda f: f"CASE WHEN a.docs >= {MIN_DOCS} THEN {f('a')} WHEN l.docs >= {MIN_DOCS} THEN {f('l')} ELSE {f('c')} END"
    outside = " OR ".join(
        f"(ratio = '{k}' AND (v > high{' OR v < low' if both else ''}))" for k, (_, _, _, _, both) in RATIOS.items()
    )
    return f"""
    WITH {_STATS},
    vals AS ({values}),
    cells AS (SELECT *, {cell} AS c FROM vals),
    q0 AS ({quartiles("lang, source")}), q1 AS ({quartiles("lang")}), q2 AS ({quartiles("1 AS one")}),
    f AS (SELECT a.lang, a.source, a.ratio, {pick(fence[0])} AS low, {pick(fence[1])} AS high
          FROM q0 a JOIN q1 l USING (lang, ratio) JOIN q2 c USING (ratio)),
    bad AS (SELECT DISTINCT r FROM vals JOIN f USING (lang, source, ratio) WHERE {outside})
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM b"""


_WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    m AS (SELECT html, max(page_id) AS largest FROM p GROUP BY html),
    x AS (SELECT page_id, html, CASE WHEN strlen(html) >= {MIN_REVISIT} AND page_id <> largest THEN largest END AS refers_to
          FROM p JOIN m USING (html))
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
           CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM x"""

_LINES = rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no
               FROM documents WHERE text IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k FROM l WHERE regexp_matches(line, '{_WORDY}')),
    pairs AS (SELECT p.doc_id, p.k, p.no, length(p.line) AS chars, q.doc_id AS other, p.k - q.k AS shift
              FROM k p JOIN k q ON p.line = q.line AND (q.doc_id < p.doc_id OR (q.doc_id = p.doc_id AND q.k < p.k))),
    islands AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY k) AS island FROM pairs),
    runs AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id, other, shift, island) AS run_chars FROM islands),
    dead AS (SELECT DISTINCT doc_id, no FROM runs WHERE run_chars >= {MIN_CHARS}),
    kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) AS text, bool_or(regexp_matches(line, '{_WORDY}')) AS wordy
             FROM l LEFT JOIN dead ON dead.doc_id = l.doc_id AND dead.no = l.no WHERE dead.no IS NULL GROUP BY l.doc_id),
    n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id), x AS (SELECT doc_id, count(*) AS x FROM dead GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN x IS NULL THEN d.text WHEN wordy THEN kept.text ELSE '' END AS text,
           coalesce(n, 0) AS n_lines, coalesce(x, 0) AS n_deleted
    FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)"""


def _crc32(text: str) -> str:
    """zlib's crc32 of an ASCII string in DuckDB, bit by bit."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    eight = "c"
    for _ in range(8):
        eight = f"list_transform([{eight}], lambda c: {step})[1]"
    chars = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT))"
    return f"xor(list_reduce({chars}, lambda a, x: list_transform([xor(a, x)], lambda c: {eight})[1]), 4294967295::BIGINT)"


#: Levels of a tree that the SQL below unrolls: FANOUT ** LEVELS leaves.
LEVELS = 6


def _merkle() -> str:
    def leaf(text: str) -> str:
        fields = "doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, base: str) -> list[str]:
        """CTEs name0 .. nameLEVELS of (g, i, d, n): the nodes of every level, and nameK_runs with each run's digests."""
        out = [f"{name}0 AS ({base})"]
        for k in range(LEVELS):
            out.append(
                f"{name}{k}_runs AS (SELECT g, i // {FANOUT} AS i, any_value(n) AS n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY ALL)"
            )
            out.append(
                f"{name}{k + 1} AS (SELECT g, i, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d,"
                f" (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}{k}_runs)"
            )
        return out

    def climb(name: str, start: str, group: str, index: str) -> list[str]:
        """CTEs up_nameK: start with the proof so far and the digest folded so far."""
        out = [f"up_{name}0 AS (SELECT * FROM {start})"]
        for k in range(LEVELS):
            place = f"(u.{index} // {FANOUT**k} % {FANOUT})::BIGINT"
            left = f"array_to_string(ds[1:{place}], '')"
            right = f"array_to_string(ds[{place} + 2:], '')"
            out.append(
                f"up_{name}{k + 1} AS (SELECT u.* EXCLUDE (proof, fold), CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,"
                f" CASE WHEN r.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold"
                f" FROM up_{name}{k} u JOIN {name}{k}_runs r ON r.g = u.{group} AND r.i = u.{index} // {FANOUT ** (k + 1)})"
            )
        return out

    ctes = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf(lowered)} AS forged, {_crc32('doc_id::VARCHAR')} AS crc FROM documents)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,"
        " count(*) OVER (PARTITION BY source) AS n FROM leaves)",
        *tree("a", "SELECT s AS g, i, leaf AS d, n FROM placed"),
        *tree("b", f"SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM a{LEVELS}"),
        f"started AS (SELECT *, 0 AS one, '' AS proof, CASE WHEN crc % {TAMPER_EVERY} = 0 THEN forged ELSE leaf END AS fold FROM placed)",
        *climb("a", "started", "s", "i"),
        *climb("b", f"up_a{LEVELS}", "one", "s"),
    ]
    return (
        "WITH " + ",\n    ".join(ctes) + f"""
    SELECT doc_id, leaf, a{LEVELS}.d AS subroot, b{LEVELS}.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
           fold = b{LEVELS}.d AS verified, source, u.i AS position
    FROM up_b{LEVELS} u JOIN a{LEVELS} ON a{LEVELS}.g = u.s CROSS JOIN b{LEVELS}"""
    )


_DIVERGENCE = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    o AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_TERM_DOCS}),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
    full_c AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
               FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS p FROM full_c JOIN v USING (lang)),
    lang_c AS (SELECT lang, term, sum(c) AS c FROM p GROUP BY ALL),
    q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q FROM lang_c JOIN v USING (lang)),
    pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
    x AS (SELECT 'pair' AS part, * FROM pairs UNION ALL SELECT 'term' AS part, * FROM terms),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranks WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

ORACLES: dict[str, str] = {
    "op6_quality_rules": _quality_rules(),
    "op7_warc": _WARC,
    "op8_line_dedup": _LINES,
    "op11_merkle_manifest": _merkle(),
    "op13_source_divergence": _DIVERGENCE,
}
