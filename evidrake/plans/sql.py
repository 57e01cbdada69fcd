"""The flow in SQL (DuckDB's dialect), as named parts that the registered oracles put together.

Word edges are ``\\b`` here, as that engine's are ASCII ones; texts of the driver tables hold no blank lines, so their
paragraphs are packed in one, and long ones are cut into windows.
"""

from __future__ import annotations

from ..functions import lexicon as L

P = L.PLACES


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains({quoted(L.STOPWORDS)}, w))"


def stem(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 4 AND {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' WHEN length({x}) > 4 AND {x} LIKE '%ing' THEN left({x}, length({x}) - 3) "
        f"WHEN length({x}) > 4 AND {x} LIKE '%ed' THEN left({x}, length({x}) - 2) WHEN length({x}) > 3 AND {x} LIKE '%es' THEN left({x}, length({x}) - 2) "
        f"WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def stems(x: str, besides: list[str] | None = None) -> str:
    out = quoted([*L.QUESTION_STOPWORDS, *(besides or [])])
    return f"list_transform(list_filter({tokens(x)}, lambda w: NOT list_contains({out}, w)), lambda w: {stem('w')})"


def sentences(x: str) -> str:
    parts = rf"string_split_regex(regexp_replace({x}, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30) || '|\n{{2,}}')"
    return f"list_filter(list_transform({parts}, lambda s: {trim('s')}), lambda s: s <> '')"


def protected(x: str) -> str:
    for first, second in (("[ap]", "m"), ("i", "e"), ("e", "g")):
        x = rf"regexp_replace({x}, '(?i)\b({first})\.{second}\.', '\1<period>{second}<period>', 'g')"
    return f"list_transform({sentences(x)}, lambda s: replace(s, '<period>', '.'))"


def has(x: str, words: str) -> str:
    words = words.replace("'", "''")
    return rf"regexp_matches({x}, '(?i)\b(?:{words})\b')"


def negation(x: str) -> str:
    return has(x, L.NEGATION_WORDS)


def yes_no(x: str) -> str:
    body = rf"regexp_replace({trim(x)}, '(?i)^according to [^,]+,\s*', '')"
    return rf"(regexp_matches({body}, '(?i)^(?:{L.YES_NO_STARTS})\b') AND NOT {negation(body)})"


def about_instruction(x: str) -> str:
    return f"({has(x, L.INSTRUCTION_NOUNS)} AND {has(x, L.REPORTING_VERBS)})"


def compact(question: str, passage: str) -> str:
    measure = rf"(?i)[{L.CURRENCY}]|\b\d+(?:\.\d+)?\s*(?:{L.MEASURE_UNITS})\b"
    return f"({has(question, L.COMPACT_WORDS)} OR ({has(question, L.METRIC_WORDS)} AND regexp_matches({passage}, '{measure}')))"


def window_chunks(source: str, target: int = L.TARGET_CHARS, overlap: int = L.OVERLAP_CHARS) -> str:
    """chunks(doc_id, chunk_index, text) of texts without blank lines."""
    step = target - overlap
    return f"""
    plain AS (SELECT doc_id, {trim("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM {source}),
    cut AS (SELECT doc_id, t, length(t) > {L.WRAP_FACTOR * target} AS long FROM plain WHERE t <> ''),
    chunks AS (
        SELECT doc_id, CAST(k AS INT) AS chunk_index, CASE WHEN long THEN {trim(f"substr(t, CAST(k * {step} + 1 AS BIGINT), {target})")} ELSE t END AS text
        FROM (SELECT doc_id, t, long, unnest(range(0, CASE WHEN long THEN CAST(ceil((length(t) - {target}) / {step}.0) AS BIGINT) + 1 ELSE 1 END)) AS k FROM cut))"""


def packed_chunks(source: str, target: int = L.TARGET_CHARS, overlap: int = L.OVERLAP_CHARS) -> str:
    """chunks(doc_id, chunk_index, text) by packing paragraphs, as a recursion over them."""
    tail = f"right(held, {overlap})" if overlap else "held"
    step = target - overlap
    return f"""
    plain AS (SELECT doc_id, {trim("replace(text, chr(13) || chr(10), chr(10))")} AS t FROM {source}),
    parts AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda p: {trim("p")}), lambda p: p <> '') AS ps FROM plain WHERE t <> ''),
    walk AS (
        SELECT doc_id, t, ps, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS done FROM parts
        UNION ALL
        SELECT doc_id, t, ps, i + 1,
               CASE WHEN i >= len(ps) THEN '' WHEN held = '' THEN ps[i + 1]
                    WHEN length(held) + length(ps[i + 1]) > {target} THEN {tail} || chr(10) || chr(10) || ps[i + 1] ELSE held || chr(10) || chr(10) || ps[i + 1] END,
               CASE WHEN held <> '' AND (i >= len(ps) OR length(held) + length(ps[i + 1]) > {target}) THEN {trim("held")} END
        FROM walk WHERE i <= len(ps)),
    made AS (SELECT doc_id, any_value(t) AS t, list(done ORDER BY i) FILTER (WHERE done IS NOT NULL AND done <> '') AS cs FROM walk GROUP BY doc_id),
    chunks AS (
        SELECT doc_id, CAST(k AS INT) AS chunk_index, CASE WHEN long THEN {trim(f"substr(t, CAST(k * {step} + 1 AS BIGINT), {target})")} ELSE cs[k + 1] END AS text
        FROM (SELECT doc_id, t, cs, len(cs) <= 1 AND length(t) > {L.WRAP_FACTOR * target} AS long,
                     unnest(range(0, CASE WHEN len(cs) <= 1 AND length(t) > {L.WRAP_FACTOR * target}
                         THEN CAST(ceil((length(t) - {target}) / {step}.0) AS BIGINT) + 1 ELSE len(cs) END)) AS k FROM made))"""


def index() -> str:
    """split, tf, vocabulary, weighted, norms, known, unseen from chunks."""
    return f"""
    split AS (SELECT doc_id, chunk_index, {tokens("text")} AS ts FROM chunks),
    sizes AS (SELECT doc_id, count(*) AS n_chunks FROM split GROUP BY doc_id),
    tf AS (SELECT doc_id, chunk_index, term, n_tokens, count(*) AS tf FROM (SELECT doc_id, chunk_index, len(ts) AS n_tokens, unnest(ts) AS term FROM split) GROUP BY ALL),
    vocabulary AS (SELECT doc_id, term, count(*) AS df, ln((any_value(n_chunks) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN sizes USING (doc_id) GROUP BY doc_id, term),
    weighted AS (SELECT doc_id, chunk_index, term, CAST(tf AS DOUBLE) / n_tokens * idf AS weight FROM tf JOIN vocabulary USING (doc_id, term)),
    norms AS (SELECT doc_id, chunk_index, sqrt(sum(weight * weight)) AS norm FROM weighted GROUP BY ALL),
    known AS (SELECT doc_id, {stem("term")} AS stem, max(idf) AS weight FROM vocabulary GROUP BY ALL),
    unseen AS (SELECT doc_id, greatest(1, max(weight)) AS unseen FROM known GROUP BY doc_id)"""


def retrieval(k: int = L.TOP_K) -> str:
    """retrieved(question_id, doc_id, rank, chunk_index, score, text) from questions and asks."""
    return f"""
    qt AS (SELECT question_id, term, count(*) / any_value(n) AS share FROM (SELECT question_id, len({tokens("question")}) AS n,
        unnest({tokens("question")}) AS term FROM questions) GROUP BY question_id, term),
    wanted AS (SELECT question_id, doc_id, term, share * idf AS wq FROM asks JOIN qt USING (question_id) JOIN vocabulary USING (doc_id, term)),
    lengths AS (SELECT question_id, doc_id, sqrt(sum(wq * wq)) AS q_norm FROM wanted GROUP BY ALL),
    dots AS (SELECT question_id, doc_id, chunk_index, sum(wq * weight) AS dot FROM wanted JOIN weighted USING (doc_id, term) GROUP BY ALL),
    scored AS (SELECT question_id, doc_id, chunk_index, dot / (q_norm * norm) AS score FROM dots JOIN lengths USING (question_id, doc_id) JOIN norms USING (doc_id, chunk_index)),
    every AS (SELECT question_id, doc_id, chunk_index, text, coalesce(score, 0) AS score FROM asks JOIN chunks USING (doc_id) LEFT JOIN scored USING (question_id, doc_id, chunk_index)),
    retrieved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(score, {P}) DESC, chunk_index) AS rank FROM every) WHERE rank <= {k})"""


def _coverage(name: str, besides: list[str] | None, evidence: str, more: str) -> str:
    """name(question_id, doc_id, more..., coverage, overlap): of the question's stems in the stems of ``evidence`` rows (es)."""
    return f"""
    {name}_t AS (SELECT question_id, s AS stem, min(p) AS pos FROM (SELECT question_id, unnest({stems("question", besides)}) AS s,
        generate_subscripts({stems("question", besides)}, 1) AS p FROM questions) GROUP BY question_id, s),
    {name}_w AS (SELECT question_id, doc_id, stem, pos, coalesce(weight, unseen, 1) AS w FROM asks
        JOIN {name}_t USING (question_id) LEFT JOIN known USING (doc_id, stem) LEFT JOIN unseen USING (doc_id)),
    {name} AS (SELECT e.question_id, e.doc_id, {more}, coalesce(sum(CASE WHEN list_contains(es, stem) THEN w ELSE 0 END) / nullif(sum(w), 0), 0) AS coverage, count(CASE WHEN list_contains(es, stem) THEN 1 END) AS overlap
               FROM {evidence} e LEFT JOIN {name}_w USING (question_id, doc_id) GROUP BY ALL)"""


def decision(threshold: float = L.COVERAGE) -> str:
    """decisions(question_id, doc_id, top_score, margin, reason, support_kind, support_span, selected_rank, evidence_coverage)."""
    relevant = f"round(score, {P}) >= {L.RELEVANCE}"
    return f"""
    passages AS (SELECT question_id, doc_id, rank, {stems("text")} AS es FROM retrieved),
    {_coverage("covered", None, "passages", "rank")},
    best AS (SELECT question_id, doc_id, rank, coverage FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(coverage, {P}) DESC, rank) AS r FROM covered) WHERE r = 1),
    keys AS (SELECT question_id, doc_id, stem AS key_term FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(w, {P}) DESC, pos) AS r FROM covered_w) WHERE r = 1),
    tops AS (SELECT question_id, doc_id, max(CASE WHEN rank = 1 THEN score END) AS top_score, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second FROM retrieved GROUP BY ALL),
    lines AS (SELECT question_id, doc_id, question, rank, {sentences("text")} AS ss FROM retrieved JOIN questions USING (question_id) WHERE {relevant}),
    each_line AS (SELECT question_id, doc_id, question, rank, ss, unnest(range(1, len(ss) + 1)) AS i FROM lines),
    denied AS (SELECT question_id, doc_id, rank, i, ss[i] AS s, array_to_string(ss[i : i + 1], ' ') AS span, {stems("ss[i]")} AS es FROM each_line WHERE {negation("ss[i]")} AND {yes_no("question")}),
    {_coverage("neg", L.FRAMING_TERMS, "denied", "rank, i, s, span")},
    terms_n AS (SELECT question_id, len({stems("question", L.FRAMING_TERMS)}) AS n FROM questions),
    negative AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY NOT regexp_matches(s, '(?i)^(?:{L.NEGATION_STARTS})\\b'), round(coverage, {P}) DESC, rank, i) AS r
                 FROM neg JOIN terms_n USING (question_id) WHERE n > 0 AND overlap >= CASE WHEN n > 1 THEN 2 ELSE 1 END AND round(coverage, {P}) >= {L.NEGATIVE_COVERAGE}) WHERE r = 1),
    spans AS (SELECT question_id, doc_id, rank, i, l, array_to_string(ss[i : i + l - 1], ' ') AS span FROM each_line, (VALUES (1), (2)) v(l) WHERE i + l - 1 <= len(ss) AND {about_instruction("question")}),
    told AS (SELECT *, {stems("span")} AS es FROM spans WHERE {has("span", L.INSTRUCTION_EVIDENCE)}),
    {_coverage("ins", L.META_TERMS, "told", "rank, i, l, span")},
    terms_i AS (SELECT question_id, len({stems("question", L.META_TERMS)}) AS n FROM questions),
    instruction AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(coverage, {P}) DESC, length(span), rank, i, l) AS r
                    FROM ins JOIN terms_i USING (question_id) WHERE n = 0 OR (overlap >= 1 AND round(coverage, {P}) >= {L.INSTRUCTION_COVERAGE})) WHERE r = 1),
    joined AS (
        SELECT a.question_id, a.doc_id, coalesce(t.top_score, 0) AS top_score, coalesce(t.top_score, 0) - coalesce(t.second, 0) AS margin, b.rank AS best_rank, coalesce(b.coverage, 0) AS best_coverage,
               n.rank AS n_rank, n.span AS n_span, n.coverage AS n_coverage, i.rank AS i_rank, i.span AS i_span, i.coverage AS i_coverage,
               t.top_score IS NOT NULL AND round(t.top_score, {P}) >= {L.RELEVANCE} AS relevant, k.key_term IS NULL OR list_contains(p.es, k.key_term) AS key_present
        FROM asks a LEFT JOIN tops t USING (question_id, doc_id) LEFT JOIN best b USING (question_id, doc_id) LEFT JOIN keys k USING (question_id, doc_id)
        LEFT JOIN passages p ON p.question_id = a.question_id AND p.doc_id = a.doc_id AND p.rank = b.rank
        LEFT JOIN negative n ON n.question_id = a.question_id AND n.doc_id = a.doc_id LEFT JOIN instruction i ON i.question_id = a.question_id AND i.doc_id = a.doc_id),
    decisions AS (
        SELECT question_id, doc_id, top_score, margin,
               CASE WHEN NOT relevant THEN 'no_relevant_chunk' WHEN n_rank IS NOT NULL OR i_rank IS NOT NULL OR (round(best_coverage, {P}) >= {threshold} AND key_present) THEN 'supported' ELSE 'insufficient_evidence' END AS reason,
               CASE WHEN NOT relevant THEN 'standard' WHEN n_rank IS NOT NULL THEN 'explicit_negative' WHEN i_rank IS NOT NULL THEN 'instruction_description' ELSE 'standard' END AS support_kind,
               CASE WHEN relevant THEN coalesce(n_span, i_span) END AS support_span, CASE WHEN relevant THEN coalesce(n_rank, i_rank, best_rank) ELSE 1 END AS selected_rank,
               CASE WHEN relevant THEN greatest(best_coverage, CASE WHEN n_rank IS NOT NULL THEN n_coverage ELSE coalesce(i_coverage, 0) END) ELSE 0 END AS evidence_coverage
        FROM joined)"""


def answers() -> str:
    """answered(question_id, doc_id, ..., answer, cited) from decisions."""
    again = f"list_distinct(list_transform({stems('question')}, lambda w: {stem('w')}))"
    inside = f"list_transform({stems('x')}, lambda w: {stem('w')})"
    return f"""
    picked AS (SELECT d.*, q.question, r.text, r.chunk_index, {compact("q.question", "r.text")} AS short FROM decisions d JOIN questions q USING (question_id)
               LEFT JOIN retrieved r ON r.question_id = d.question_id AND r.doc_id = d.doc_id AND r.rank = d.selected_rank),
    to_cut AS (SELECT question_id, doc_id, question, text, {protected("text")} AS ss FROM picked WHERE reason = 'supported' AND support_span IS NULL AND short),
    q_stems AS (SELECT question_id, unnest({again}) AS stem FROM questions),
    q_weights AS (SELECT c.question_id, c.doc_id, stem, coalesce(weight, unseen, 1) AS w FROM to_cut c JOIN q_stems USING (question_id) LEFT JOIN known USING (doc_id, stem) LEFT JOIN unseen USING (doc_id)
                  WHERE list_contains({inside.replace("(x)", "(c.text)")}, stem)),
    cuts AS (SELECT question_id, doc_id, i, l, array_to_string(ss[i : i + l - 1], ' ') AS span, list_transform(ss[i : i + l - 1], lambda x: {inside}) AS inner_stems
             FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM to_cut), (VALUES (1), (2)) v(l) WHERE i + l - 1 <= len(ss) AND len(ss) > 1),
    weighed AS (SELECT question_id, doc_id, i, l, span, sum(CASE WHEN list_contains(flatten(inner_stems), stem) THEN w ELSE 0 END) AS weight FROM cuts JOIN q_weights USING (question_id, doc_id) GROUP BY ALL),
    best_cut AS (SELECT question_id, doc_id, span FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(weight, {P}) DESC, l DESC,
        length(span), i) AS r FROM weighed) WHERE r = 1 AND round(weight, {P}) > 0),
    answered AS (
        SELECT p.*, CASE WHEN reason <> 'supported' THEN '{L.REFUSAL.replace("'", "''")}' ELSE
               CASE support_kind WHEN 'explicit_negative' THEN 'No. ' WHEN 'instruction_description' THEN 'The document says: ' ELSE '' END
               || coalesce(support_span, CASE WHEN short THEN coalesce(b.span, {trim("p.text")}) ELSE p.text END) END AS answer,
               CASE WHEN reason = 'supported' THEN 'chunk_' || chunk_index ELSE '' END AS cited
        FROM picked p LEFT JOIN best_cut b ON b.question_id = p.question_id AND b.doc_id = p.doc_id)"""
