"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from rasterloom.llm.decontam import MASKS, SEPARATORS, UPPER
from rasterloom.llm.licenses import AGREE, BASE, NOTICES, postings

_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '" + SEPARATORS + "'), lambda x: x <> '')"
_TURN = "'<|' || coalesce(t.role, 'unknown') || E'|>\\n' || coalesce(t.text, '') || E'<|end|>\\n'"


def _render(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: {_TURN}), ''), '')"


def _spans(turns: str) -> str:
    size = f"list_transform({turns}, lambda t: length({_TURN}))"
    before = f"coalesce(list_sum(list_slice({size}, 1, i - 1)), 0)::BIGINT"
    head = f"length(coalesce({turns}[i].role, 'unknown')) + 5"
    each = f"list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), lambda i: ({before} + {head}) || '-' || ({before} + {size}[i]))"
    return f"coalesce(array_to_string({each}, ','), '')"


PREFERENCES = f"""WITH sides AS (SELECT (conv_id - (conv_id & 1)) // 2 AS pair_id,
coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (conv_id & 1 = 0), []) AS c,
coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (conv_id & 1 = 1), []) AS r FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
shared AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])[1] - 1, least(len(c), len(r))) AS n FROM sides),
cut AS (SELECT pair_id, len(c) > 0 AND len(r) > 0 AS has_both, n::INTEGER AS n_prompt_turns, list_slice(c, 1, n) AS p, list_slice(c, n + 1, len(c)) AS c, list_slice(r, n + 1, len(r)) AS r FROM shared)
SELECT pair_id, has_both, n_prompt_turns, {_render("p")} AS prompt, {_render("c")} AS chosen, {_spans("c")} AS chosen_spans, {_render("r")} AS rejected, {_spans("r")} AS rejected_spans FROM cut"""


def _seeds(source: str, key: str) -> str:
    parts = [f"SELECT {key}, {m} AS mask, i AS at, concat_ws(' ', {', '.join(f'w[i + {o + 1}]' for o in mask)}) AS seed FROM {source}, unnest(range(len(w) - {mask[-1]})) s(i) WHERE len(w) > {mask[-1]}" for m, mask in enumerate(MASKS)]
    return " UNION ALL ".join(parts)


OVERLAPS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), item AS (SELECT * FROM b WHERE len(w) >= 9),
hits AS (SELECT DISTINCT doc_id, item_id, x.at - y.at AS shift FROM ({_seeds("d", "doc_id")}) x JOIN ({_seeds("item", "item_id")}) y USING (mask, seed)),
lined AS (SELECT h.doc_id, h.item_id, least(13, len(i.w)) AS win, list_transform(range(len(i.w)), lambda j: CASE WHEN j + h.shift >= 0 AND j + h.shift < len(d.w) THEN (i.w[j + 1] = d.w[j + h.shift + 1])::INTEGER END) AS same FROM hits h JOIN d USING (doc_id) JOIN item i ON i.item_id = h.item_id),
tried AS (SELECT doc_id, item_id, win, list_max(list_transform(range(len(same) - win + 1), lambda s: CASE WHEN same[s + 1] IS NOT NULL AND same[s + win] IS NOT NULL THEN list_sum(list_slice(same, s + 1, s + win)) ELSE 0 END)) AS matched FROM lined)
SELECT doc_id, item_id, max(matched)::INTEGER AS matched, max(win)::INTEGER AS "window" FROM tried WHERE matched >= win - CASE WHEN win < 13 THEN 1 ELSE 2 END GROUP BY ALL"""

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AS ok FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.ok AND y.ok AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(low.b, v.vec_id)) AS kept FROM v LEFT JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


def _rows(rows: list[tuple]) -> str:
    lit = lambda x: "'" + x + "'" if isinstance(x, str) else "[" + ", ".join(map(lit, x)) + "]" if isinstance(x, list) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def _notices() -> list[tuple]:
    """(notice, label, place of the key phrase, its words)."""
    out = []
    for i, (label, key, text) in enumerate(NOTICES):
        words, key = text.split(), key.split()
        out.append((i, label, next(p for p in range(len(words)) if words[p : p + len(key)] == key), key))
    return out


_BASE = [(label, " AND ".join(f"w[i + {1 + k}] = '{x}'" for k, x in enumerate(phrase.split()))) for phrase, label in BASE]
_VOCABULARY = ", ".join(f"'{w}'" for w in sorted({w for _, w, _ in postings()}))
LICENSES = f"""WITH d AS (SELECT row_number() OVER () AS file, doc_id, {_WORDS} AS w FROM documents),
based AS (SELECT file, doc_id, w, list_filter(range(len(w)), lambda i: {" OR ".join(f"({test})" for _, test in _BASE)}) AS places, list_sort(list_distinct(flatten([{", ".join(f"CASE WHEN len(list_filter(range(len(w)), lambda i: {test})) > 0 THEN ['{label}'] ELSE [] END" for label, test in _BASE)}]))) AS base FROM d),
hits AS (SELECT file, w[i + 1] AS word, i AS spot FROM d, unnest(range(len(w))) s(i) WHERE w[i + 1] IN ({_VOCABULARY})),
words AS (SELECT DISTINCT file, word FROM hits),
weight AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / count(*)) AS idf FROM words GROUP BY word),
idx AS (SELECT * FROM {_rows(postings())} v(notice, word, place)),
whole AS (SELECT notice, sum(coalesce(idf, 0)) AS full_idf, count(*) AS n_index FROM (SELECT DISTINCT notice, word FROM idx) LEFT JOIN weight USING (word) GROUP BY notice),
agree AS (SELECT file, notice, shift, count(*) AS n, sum(idf) AS idf FROM (SELECT DISTINCT file, notice, spot - place AS shift, word, idf FROM hits JOIN weight USING (word) JOIN idx USING (word)) GROUP BY ALL),
need AS (SELECT * FROM {_rows(_notices())} v(notice, label, place, phrase)),
confirmed AS (SELECT a.file, list(DISTINCT label) AS labels, max(CASE WHEN full_idf > 0 THEN least(1, idf / full_idf) ELSE 0 END) AS score FROM agree a JOIN whole USING (notice) JOIN need USING (notice) JOIN d USING (file) WHERE n >= least({AGREE}, n_index) AND shift + place >= 0 AND list_slice(w, shift + place + 1, shift + place + len(phrase)) = phrase GROUP BY a.file)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(c.labels, [])))), ','), '') AS labels, round(coalesce(c.score, 0), 6)::DOUBLE AS score FROM based LEFT JOIN confirmed c USING (file)"""
