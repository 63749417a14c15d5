"""DuckDB SQL that gives the rows of registered queries."""

from __future__ import annotations

from tidyloom.llm import decontaminate, mixing, rules, substrings

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"


def op8_rules() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules.RULES))
    return f"""
    WITH split AS (
        SELECT doc_id, {_WORDS} AS w, coalesce(text, '') AS t,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)
    ), twice AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
    ), covered AS (
        SELECT doc_id, sum(least(8, coalesce(next - i, 8))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id
    ), measured AS (
        SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \\t-\\r]', '', 'g'))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
        FROM split LEFT JOIN covered USING (doc_id)
    ), judged AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM measured)
    SELECT *, fail_bits & {rules.mask("base")} <> 0 AS base_failed, fail_bits & {rules.mask("base") | rules.mask("v2")} = 0 AS kept
    FROM judged"""


def op5_substrings() -> str:
    n = substrings.WINDOW
    return f"""
    WITH split AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM split)
    ),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM twice),
    listed AS (SELECT doc_id, list(p) AS p, count(*) AS n FROM gone GROUP BY doc_id),
    placed AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM split),
    kept AS (
        SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM split LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


_PLAIN = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)


def op6_decontamination() -> str:
    return f"""
    WITH bench AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
    sized AS (SELECT item_id, w, least({decontaminate.WINDOW}, len(w)) AS n FROM bench WHERE len(w) > 0),
    wanted AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
    ),
    docs AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
    lengths AS (SELECT DISTINCT n FROM wanted),
    windows AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
    ),
    found AS (SELECT doc_id, i, d.n, item_id FROM windows AS d JOIN wanted USING (n, g)),
    hit AS (
        SELECT doc_id, count(*) AS n_hit FROM (
            SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found
        ) GROUP BY doc_id
    ),
    listed AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def mixed(docs: str) -> str:
    """CTEs that end in ``mixed``: the rows of ``docs`` with what the mix takes of them."""
    listed = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    return f"""
    sized AS (
        SELECT *, len({_WORDS})::BIGINT AS size,
               md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS h
        FROM {docs}
    ), ranked AS (
        SELECT source, sum(size)::HUGEINT AS s, {mixing.EPOCHS} * sum(size)::HUGEINT AS cap,
               {listed}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::HUGEINT AS w
        FROM sized GROUP BY source
    ), poured AS (
        SELECT *, sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
               sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
        FROM ranked
    ), clamped AS (
        SELECT *, bool_and(cap * ws < l * w) OVER (ORDER BY cap / w, source) AS full_up FROM poured
    ), level AS (
        SELECT coalesce(max(l) FILTER (NOT full_up), 0) AS l, coalesce(max(ws) FILTER (NOT full_up), 1) AS ws FROM clamped
    ), aimed AS (
        SELECT source, s::BIGINT AS source_size, CASE WHEN full_up THEN cap::DOUBLE ELSE level.l::DOUBLE * w::DOUBLE / level.ws::DOUBLE END AS target,
               (CASE WHEN full_up THEN cap ELSE (level.l * w)::HUGEINT // level.ws::HUGEINT END)::BIGINT AS aim
        FROM clamped, level
    ), state AS (
        SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE aim // source_size END AS times,
               CASE WHEN source_size = 0 THEN aim ELSE aim % source_size END AS need
        FROM aimed
    ), places AS (SELECT source, h, doc_id, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL),
    one AS (
        SELECT p.*, need, greatest(0, least(n, (need - upto + size * n) // size)) AS a FROM (
            SELECT p.*, need, sum(size * n) OVER (PARTITION BY p.source ORDER BY h, doc_id NULLS FIRST, size) AS upto
            FROM places AS p JOIN state ON p.source IS NOT DISTINCT FROM state.source
        ) AS p
    ), open1 AS (SELECT *, need - sum(a * size) OVER (PARTITION BY source) AS r FROM one),
    two AS (
        SELECT *, CASE WHEN size <= r THEN greatest(0, least(n - a, (r - filled + size * (n - a)) // size)) ELSE 0 END AS b FROM (
            SELECT *, sum(size * (n - a)) OVER (PARTITION BY source ORDER BY size, h, doc_id NULLS FIRST) AS filled FROM open1
        )
    ), open2 AS (SELECT *, r - sum(b * size) OVER (PARTITION BY source) AS o FROM two),
    last AS (SELECT source, min((size, h, doc_id)) AS l FROM open2 WHERE o > 0 AND n > a + b AND size < 2 * o GROUP BY source),
    allowed AS (
        SELECT t.*, a + b + coalesce(l = (size, h, doc_id), false)::INT AS k FROM open2 AS t LEFT JOIN last ON t.source IS NOT DISTINCT FROM last.source
    ), mixed AS (
        SELECT d.*, s.source_size, s.target, (times + (coalesce(k, 0) >= no)::INT)::BIGINT AS copies
        FROM (SELECT *, row_number() OVER (PARTITION BY source, h, doc_id, size) AS no FROM sized) AS d
        JOIN state AS s ON d.source IS NOT DISTINCT FROM s.source
        LEFT JOIN allowed AS k ON d.h = k.h AND d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.size = k.size AND d.source IS NOT DISTINCT FROM k.source
    )"""


def op3_mixing() -> str:
    return f"""WITH {mixed("documents")}
    SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM mixed"""


def op11_conversations() -> str:
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    bare = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    # Costs, audits and repaired texts of what follows, per state: 0 nothing yet, s, u, a.
    text = lambda role: f"'{role}:' || text"
    option = lambda cost, letter, made, to: f"{{c: {cost} + {to}.c, l: '{letter}' || {to}.l, r: list_prepend({made}, {to}.r)}}"
    never = "{c: 999999999999, l: '', r: []::VARCHAR[]}"

    def row(state: str) -> str:
        to, role = ("a", "assistant") if state == "u" else ("u", "user")
        delete = f"{{c: 3 + p{state}.c, l: 'D' || p{state}.l, r: p{state}.r}}"
        keep = f"CASE WHEN NOT gone AND i = '{to}' THEN {option('cut', 'K', "role || ':' || text", 'p' + to)} ELSE {never} END"
        if state == "n":
            keep += f", CASE WHEN NOT gone AND i = 's' THEN {option('cut', 'K', "role || ':' || text", 'ps')} ELSE {never} END"
        rerole = f"CASE WHEN NOT gone THEN {option('2 + cut', 'R', text(role), 'p' + to)} ELSE {never} END"
        return f"list_min([{delete}, {keep}, {rerole}])"

    insert = lambda role, to: f"{{c: 2 + {to}.c, l: 'I' || {to}.l, r: list_prepend('{role}:', {to}.r)}}"
    return f"""
    WITH RECURSIVE bits AS (
        SELECT n, n AS c, 0 AS k FROM range(256) AS x(n)
        UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
    ), codes AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
    named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
    ), harmed AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM named, codes),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM harmed, range(2) AS copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, {bare} AS bare, role[1] AS i
        FROM damaged
    ), judged AS (
        SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS again,
               bare <> '' AND nth = 1 AND bare[-1] NOT IN ('.', '!', '?') AS short,
               row_number() OVER own AS pos, lag(i) OVER own AS before
        FROM numbered WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
    ), rows AS (
        SELECT conv_id, pos, blank OR again AS gone, short::BIGINT AS cut, i, role, text FROM judged
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
               count(*) FILTER (again)::BIGINT AS duplicate, count(*) FILTER (short)::BIGINT AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(*) AS size
        FROM judged GROUP BY conv_id
    ), convs AS (SELECT DISTINCT conv_id FROM conversations),
    solved AS (
        SELECT v.conv_id, coalesce(size, 0) AS pos, {{c: 0::BIGINT, l: '', r: []::VARCHAR[]}} AS pn, {{c: 4::BIGINT, l: 'II', r: ['user:', 'assistant:']}} AS ps,
               {{c: 2::BIGINT, l: 'I', r: ['assistant:']}} AS pu, {{c: 0::BIGINT, l: '', r: []::VARCHAR[]}} AS pa
        FROM convs AS v LEFT JOIN counted AS c ON v.conv_id IS NOT DISTINCT FROM c.conv_id
        UNION ALL
        SELECT conv_id, pos, list_min([n, {insert("user", "u2")}]), list_min([s, {insert("user", "u2")}]), u2, a2 FROM (
            SELECT *, list_min([u, {insert("assistant", "a")}]) AS u2, list_min([a, {insert("user", "u")}]) AS a2 FROM (
                SELECT d.conv_id, d.pos - 1 AS pos, {row("n")} AS n, {row("s")} AS s, {row("u")} AS u, {row("a")} AS a
                FROM solved AS d JOIN rows AS r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.pos = r.pos
            )
        )
    )
    SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, pn.c AS cost, pn.l AS audit, sha256(array_to_string(pn.r, chr(10))) AS repaired_sha256
    FROM solved AS s LEFT JOIN counted AS c ON s.conv_id IS NOT DISTINCT FROM c.conv_id WHERE s.pos = 0"""


def op12_products() -> str:
    return """
    WITH points AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.row, q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
        FROM points AS q JOIN points AS e ON q.row <> e.row WHERE q.vec_id % 20 = 0
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


ORACLES = {
    "op3_mixing": op3_mixing(),
    "op5_substrings": op5_substrings(),
    "op6_decontamination": op6_decontamination(),
    "op8_rules": op8_rules(),
    "op11_conversations": op11_conversations(),
    "op12_products": op12_products(),
}
