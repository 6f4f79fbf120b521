"""DuckDB SQL twins of the bridge views (see ``bridge.py``) and a CTE builder."""

from __future__ import annotations

import re

from textpairs.plans.bridge import CORPORA, DIM, N_CLASSES, RESERVED, head_weights

_CORPUS_LIST = ", ".join(f"'{c}'" for c in CORPORA)


def _weights_sql() -> str:
    rows = ["[" + ", ".join(repr(w) for w in row) + "]" for row in head_weights()]
    return "[" + ", ".join(rows) + "]"


# all lines but the last joined by a space / the last line (null for one line)
_HEAD = "CASE WHEN len({l}) >= 2 THEN array_to_string({l}[1:len({l}) - 1], ' ') ELSE {l}[1] END"
_LAST = "CASE WHEN len({l}) >= 2 THEN {l}[len({l})] END"

VIEWS: dict[str, str] = {
    "v_lines": """
        SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "v_nli": f"""
        SELECT CAST(d.doc_id AS VARCHAR) AS pairID,
               {_HEAD.format(l="string_split(d.text, chr(10))")} AS sentence1,
               {_LAST.format(l="string_split(d.text, chr(10))")} AS sentence2,
               CASE WHEN l.doc_id IS NULL THEN '-'
                    WHEN l.toxic = 1 THEN 'contradiction'
                    WHEN l.quality = 1 THEN 'entailment'
                    ELSE 'neutral' END AS gold_label,
               d.source AS source
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_qqp": f"""
        SELECT d.doc_id AS id, d.doc_id * 2 AS qid1, d.doc_id * 2 + 1 AS qid2,
               {_HEAD.format(l="string_split(d.text, chr(10))")} AS question1,
               {_LAST.format(l="string_split(d.text, chr(10))")} AS question2,
               l.quality AS is_duplicate
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_turn_pairs": """
        SELECT a.conv_id, a.turn, a.conv_id AS qid1, a.conv_id + 1 AS qid2,
               a.text AS question1, b.text AS question2
        FROM conversations a JOIN conversations b
          ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "v_groups": """
        SELECT source AS paraphrase_group_index, doc_id AS phrase_index FROM documents""",
    "v_phrases": """
        SELECT doc_id AS phrase_index, replace(text, chr(10), ' ') AS phrase FROM documents""",
    "v_index": """
        SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS qid1,
               CASE WHEN n > 1 THEN array_to_string(list_reverse(range(1, n)), '/') || '/' ELSE '' END
               || CASE WHEN doc_id % 5 = 0
                       THEN '(' || CAST(doc_id AS VARCHAR) || ',0):(' || CAST(doc_id AS VARCHAR) || ',1)'
                       ELSE '0' END
               || CASE WHEN doc_id % 7 = 0 THEN '/100000' ELSE '' END
               || CASE WHEN doc_id % 11 = 0 THEN '/(' || CAST(doc_id AS VARCHAR) || ',2):(-1,0)' ELSE '' END
                 AS sentence1,
               doc_id AS qid2, array_to_string(range(n), '/') AS sentence2, CAST(doc_id % 2 AS VARCHAR) AS label
        FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)""",
    "v_qtokens": """
        SELECT doc_id AS qid, string_split(text, ' ') AS tokens FROM documents""",
    "v_corpora": f"""
        SELECT d.doc_id, [{_CORPUS_LIST}][CAST(d.doc_id % 4 + 1 AS INTEGER)] AS corpus,
               l.quality AS label, d.n_chars
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_words": """
        SELECT doc_id, line_no, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word
        FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM v_lines)""",
    "v_vocab": f"""
        SELECT word, CAST({RESERVED} - 1 + row_number() OVER (ORDER BY cnt DESC, word) AS INTEGER) AS id, cnt
        FROM (SELECT word, count(*) AS cnt FROM v_words GROUP BY word)""",
    "v_logits": f"""
        SELECT vec_id, label,
               list_transform(range({N_CLASSES}), lambda c: list_sum(list_transform(range({DIM}),
                   lambda i: CAST(embedding[i + 1] AS DOUBLE) * w[c + 1][i + 1]))) AS logits
        FROM embeddings, (SELECT {_weights_sql()} AS w)""",
    "v_metric": """
        SELECT user_id, event_id, ts, value, event_type FROM events""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs it (transitively) references, in dependency order.

    ``extra`` adds query-local CTEs (name -> body) that may reference views.
    """
    catalog = dict(VIEWS)
    catalog.update(extra or {})
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        body = catalog[n]
        for d in catalog:
            if d != n and re.search(rf"\b{d}\b", body):
                visit(d)
        order.append(n)

    for n in catalog:
        if re.search(rf"\b{n}\b", sql):
            visit(n)
    if not order:
        return sql
    bodies = [catalog[n] for n in order]

    def kind(n: str) -> str:
        # what several others read is computed once
        return "MATERIALIZED " if sum(bool(re.search(rf"\b{n}\b", b)) for b in [*bodies, sql]) > 1 else ""

    ctes = ",\n".join(f"{n} AS {kind(n)}({catalog[n]}\n)" for n in order)
    return f"WITH RECURSIVE {ctes}\n{sql}"
