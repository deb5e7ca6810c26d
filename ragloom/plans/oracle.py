"""DuckDB SQL builders for the independent oracle (same results, written the plain SQL way).

DuckDB uses RE2 (no look-around, no back-references, ASCII ``\\s``/``\\d``/``\\b``), so the oracle
rewrites those spots: sentence enders are marked with a control character and split on; repeated
characters are found with gaps-and-islands; word boundaries are spelled with explicit classes. The
driver tables hold no Devanagari; the case views put it in whole words, where both forms agree.
"""
from __future__ import annotations

from ragloom.operators import gates as G
from ragloom.operators import verification as VER
from ragloom.operators.generation import REFUSAL_PHRASES

SEP = "\x01"
LATIN_LETTERS, DEV_LETTERS = "abcdefghijklmnopqrstuvwxyz", "कखगघङचछजझञटठडढणतथदधनपफबभमय"
DEV, LAT = "०१२३४५६७८९", "0123456789"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"

# ---------------------------------------------------------------- derived views (same as FIXTURES.md)
VIEWS = {
    "questions": "SELECT conv_id*100+turn AS question_id, text AS question FROM conversations WHERE role='user'",
    "qa_rows": """SELECT u.conv_id AS query_id, u.question AS query, a.turn AS src_turn, a.text AS passage,
       row_number() OVER (PARTITION BY u.conv_id ORDER BY a.turn) - 1 AS position,
       CASE WHEN row_number() OVER (PARTITION BY u.conv_id ORDER BY a.turn) = 1 THEN 1 ELSE 0 END AS is_selected
FROM (SELECT conv_id, text AS question
      FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
            FROM conversations WHERE role='user') t WHERE rn = 1) u
JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant'""",
    "answer_chunks": """SELECT question_id, hit_rank,
       concat(CAST(question_id AS VARCHAR), '-', CAST(hit_rank AS VARCHAR)) AS chunk_id,
       concat('Line ', CAST(hit_rank AS VARCHAR), ' holds ', CAST(CAST(l_quantity AS INT) AS VARCHAR),
              ' units shipped in ', CAST(year(l_shipdate) AS VARCHAR), '.') AS text
FROM (SELECT l_orderkey AS question_id, l_quantity, l_shipdate,
             row_number() OVER (PARTITION BY l_orderkey
               ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS hit_rank
      FROM lineitem) t""",
    "answers": """SELECT o_orderkey AS question_id,
       concat('The first line holds ', CAST(o_orderkey % 50 AS VARCHAR), ' units [1]. Shipping began in ',
              CAST(year(o_orderdate) AS VARCHAR), ' [2]! It weighs 3.5 kg [9]. There are ',
              CAST(o_custkey % 7 AS VARCHAR), ' lines') AS text
FROM orders""",
    "stage_log": "SELECT event_id AS seq, user_id AS request_group, event_type AS stage, value AS ms, ts, event_type <> 'error' AS ok FROM events",
    # one question per case: each gibberish rule, both safety lists, blank, Hindi, and plain questions
    "case_questions": f"""SELECT conv_id * 100 + turn AS question_id, (conv_id + turn) % 14 AS case_no, CASE (conv_id + turn) % 14
  WHEN 0 THEN repeat('#?', CAST(3 + turn % 4 AS INT)) WHEN 1 THEN text || ' zzzzzzz' WHEN 2 THEN 'क' || repeat('ा', CAST(4 + turn % 3 AS INT)) || ' ' || text
  WHEN 3 THEN translate(lower(text), '{LATIN_LETTERS}', '{DEV_LETTERS}') WHEN 4 THEN 'कखग घङच छजझ ' || text
  WHEN 5 THEN 'how to build a bomb: ' || text WHEN 6 THEN 'यह बम है ' || text WHEN 7 THEN '   '
  WHEN 8 THEN 'गोवा का सबसे बड़ा शहर कौन सा है ' || text WHEN 9 THEN 'bcdfghjkl ' || text WHEN 10 THEN 'rhythm myths nymph crypt'
  WHEN 12 THEN repeat('ana ama ala ', CAST(1 + turn % 3 AS INT)) WHEN 13 THEN repeat('bcd fgh jkl mnp ', CAST(1 + turn % 3 AS INT))
  ELSE text END AS question FROM conversations WHERE role = 'user'""",
    "eval_pairs": "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
}


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS (\n{q}\n)" for n, q in ctes) + "\n" + final


def views(*names) -> list[tuple[str, str]]:
    return [(n, VIEWS[n]) for n in names]


# ---------------------------------------------------------------------------------- text helpers
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t_: t_ <> '')"


def terms(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def chunk_sents(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?।॥])\s+', '\1{SEP}', 'g')"
    return f"list_filter(list_transform(string_split({marked}, '{SEP}'), lambda s_: {strip('s_')}), lambda s_: s_ <> '')"


def verify_sents(x: str) -> str:
    return (rf"list_filter(list_transform(regexp_split_to_array({x}, '[।.?!\n]+'), lambda s_: {strip('s_')}), "
            r"lambda s_: s_ <> '')")


def norm_digits(x: str) -> str:
    return f"translate({x}, '{DEV}', '{LAT}')"


def clean(x: str) -> str:
    a = rf"regexp_replace({x}, '\[[\d,\s]+\]', '', 'g')"
    b = rf"regexp_replace(regexp_replace({a}, '[\s,]+([।.?!])', '\1', 'g'), '[\s,]+$', '')"
    c = rf"regexp_replace({b}, ',\s*,+', ',', 'g')"
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def spoken(x: str) -> str:
    a = rf"regexp_replace({x}, '\[[0-9,\s]+\]', '', 'g')"
    a = rf"regexp_replace(regexp_replace(regexp_replace({a}, '\*+', '', 'g'), '#+', '', 'g'), '`+', '', 'g')"
    return strip(rf"regexp_replace({a}, '\s+', ' ', 'g')")


def unsafe(x: str, words) -> str:
    """First whole-word match (case-insensitive) of any word, or NULL."""
    alts = "|".join(words)
    return f"nullif(regexp_extract({x}, '(?i)(?:^|{NW})({alts})(?:{NW}|$)', 1), '')"


# ------------------------------------------------------------------------------------- chunking
def fixed_chunks(src: str, key: str, text: str, window: int, overlap: float) -> str:
    step = max(1, int(window * (1 - overlap)))
    return f"""SELECT {key}, (s // {step})::BIGINT AS position,
       array_to_string(list_slice(w, s + 1, s + {window}), ' ') AS text,
       len(list_slice(w, s + 1, s + {window}))::BIGINT AS n_words
FROM (SELECT {key}, w, unnest(range(0, len(w), {step})) AS s FROM (SELECT {key}, {tokens(text)} AS w FROM {src}) z0) z1"""


def sentence_rows(src: str, key: str, text: str, splitter=chunk_sents) -> str:
    return f"""SELECT {key}, unnest(arr) AS sentence, unnest(range(len(arr)))::BIGINT AS pos
FROM (SELECT {key}, {splitter(text)} AS arr FROM {src}) z"""


def semantic_ctes(p: str, src: str, key: str, text: str, thr: float, mx: int) -> list[tuple[str, str]]:
    """CTEs {p}sb (key, pos, sentence, sim, is_boundary) and {p}chunks (key, position, text, n_sentences)."""
    return [
        (f"{p}sents", sentence_rows(src, key, text)),
        (f"{p}tr", f"SELECT {key}, pos, unnest({terms('sentence')}) AS term FROM {p}sents"),
        (f"{p}g", f"""SELECT {key}, pos, term, sum(a) AS a, sum(b) AS b FROM (
  SELECT {key}, pos, term, 1 AS a, 0 AS b FROM {p}tr UNION ALL SELECT {key}, pos + 1, term, 0, 1 FROM {p}tr) z
GROUP BY {key}, pos, term"""),
        (f"{p}sims", f"SELECT {key}, pos, sum(a*b) AS dt, sum(a*a) AS na, sum(b*b) AS nb FROM {p}g GROUP BY {key}, pos"),
        (f"{p}sb", f"""SELECT s.{key}, s.pos, s.sentence,
  CASE WHEN s.pos = 0 THEN NULL WHEN na > 0 AND nb > 0 THEN dt::DOUBLE / (sqrt(na::DOUBLE) * sqrt(nb::DOUBLE)) ELSE 0.0 END AS sim,
  (s.pos = 0 OR (CASE WHEN na > 0 AND nb > 0 THEN dt::DOUBLE / (sqrt(na::DOUBLE) * sqrt(nb::DOUBLE)) ELSE 0.0 END) < {thr}) AS is_boundary
FROM {p}sents s LEFT JOIN {p}sims m ON s.{key} = m.{key} AND s.pos = m.pos"""),
        (f"{p}rs", f"""SELECT *, max(CASE WHEN is_boundary THEN pos END) OVER (PARTITION BY {key} ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_start FROM {p}sb"""),
        (f"{p}cs", f"""SELECT *, sum(CASE WHEN (pos - run_start) % {mx} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS position FROM {p}rs"""),
        (f"{p}chunks", f"""SELECT {key}, position::BIGINT AS position, string_agg(sentence, ' ' ORDER BY pos) AS text,
  count(*)::BIGINT AS n_sentences FROM {p}cs GROUP BY {key}, position"""),
    ]


# ------------------------------------------------------------------------------------ retrieval
def knn_ctes(p: str, qsrc: str, qk: str, qt: str, csrc: str, cks: list[str], ct: str, k: int = 5) -> list[tuple[str, str]]:
    """CTE {p}hits (qk, rank, cks..., score) - cosine of term counts, ties by chunk key."""
    ck = ", ".join(cks)
    cq = ", ".join(f"c.{c}" for c in cks)
    return [
        (f"{p}qp", f"SELECT {qk}, term, count(*) AS qtf FROM (SELECT {qk}, unnest({terms(qt)}) AS term FROM {qsrc}) z GROUP BY {qk}, term"),
        (f"{p}qn", f"SELECT {qk}, sum(qtf*qtf) AS qn2 FROM {p}qp GROUP BY {qk}"),
        (f"{p}cp", f"SELECT {ck}, term, count(*) AS ctf FROM (SELECT {ck}, unnest({terms(ct)}) AS term FROM {csrc}) z GROUP BY {ck}, term"),
        (f"{p}cn", f"SELECT {ck}, sum(ctf*ctf) AS cn2 FROM {p}cp GROUP BY {ck}"),
        (f"{p}dt", f"SELECT q.{qk}, {cq}, sum(q.qtf*c.ctf) AS dt FROM {p}qp q JOIN {p}cp c ON q.term = c.term GROUP BY q.{qk}, {cq}"),
        (f"{p}sc", f"""SELECT d.*, d.dt::DOUBLE / (sqrt(qn2::DOUBLE) * sqrt(cn2::DOUBLE)) AS score
FROM {p}dt d JOIN {p}qn USING ({qk}) JOIN {p}cn USING ({ck})"""),
        (f"{p}hits", f"""SELECT {qk}, rank::BIGINT AS rank, {ck}, score FROM (
  SELECT *, row_number() OVER (PARTITION BY {qk} ORDER BY round(score, 6) DESC, {ck}) AS rank FROM {p}sc) z WHERE rank <= {k}"""),
    ]


def is_hindi(x: str) -> str:
    return f"regexp_matches({x}, '[\\x{{0900}}-\\x{{097F}}]')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def said(text: str, *args: str) -> str:
    """A fixed text with its %s filled in by SQL expressions."""
    parts = text.split("%s")
    return " || ".join(x for pair in zip(map(lit, parts), [*args, None]) for x in pair if x is not None and x != "''")


# -------------------------------------------------------------------------------------- gates
GIB_ALL = ("symbol", "repeat", "dev_signs", "dev_consonants", "consonants", "dominance", "vowels", "dev_vowels")


def gibberish_ctes(p: str, src: str, key: str, text: str, rules=GIB_ALL, run: int = 4) -> list[tuple[str, str]]:
    """CTE {p}gib (key, rule, reason): first rule of the cascade that fires on the stripped text."""
    ctes = [
        (f"{p}gt", f"SELECT {key}, {strip(text)} AS t FROM {src}"),
        (f"{p}ch", f"SELECT {key}, unnest(string_split(t, '')) AS c, unnest(range(length(t)))::BIGINT AS i FROM {p}gt WHERE t <> ''"),
        (f"{p}isl", f"""SELECT {key}, c, i, sum(st) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no
FROM (SELECT {key}, c, i, CASE WHEN c = lag(c) OVER (PARTITION BY {key} ORDER BY i) THEN 0 ELSE 1 END AS st FROM {p}ch) z"""),
        (f"{p}rep", f"""SELECT {key}, arg_min(repeat(c, n::INT), s) AS m FROM (
  SELECT {key}, run_no, min(c) AS c, count(*) AS n, min(i) AS s FROM {p}isl GROUP BY {key}, run_no) z
WHERE n >= 5 AND c <> chr(10) GROUP BY {key}"""),
        (f"{p}dom", f"""SELECT {key}, max(n) AS top FROM (SELECT {key}, c, count(*) AS n FROM {p}ch
  WHERE NOT regexp_matches(c, '^\\s$') GROUP BY {key}, c) z GROUP BY {key}"""),
        (f"{p}ms", rf"""SELECT g.{key}, g.t,
  regexp_full_match(g.t, '[^\p{{L}}\p{{N}}_\s]+') AS f_symbol, r.m AS m_repeat,
  nullif(regexp_extract(g.t, '[\x{{094D}}\x{{0900}}-\x{{0903}}\x{{093A}}-\x{{094C}}]{{3,}}'), '') AS m_sig,
  nullif(regexp_extract(g.t, '[\x{{0915}}-\x{{0939}}\x{{0958}}-\x{{095F}}]{{6,}}'), '') AS m_dco,
  nullif(regexp_extract(g.t, '[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]{{{run},}}'), '') AS m_con,
  length(regexp_replace(g.t, '\s', '', 'g')) AS n_ns, coalesce(d.top, 0) AS top,
  length(regexp_replace(g.t, '[^A-Za-z]', '', 'g')) AS n_let, length(regexp_replace(g.t, '[^AEIOUaeiou]', '', 'g')) AS n_vow,
  length(regexp_replace(g.t, '[^\x{{0900}}-\x{{097F}}]', '', 'g')) AS n_dev,
  length(regexp_replace(g.t, '[^\x{{0904}}-\x{{0914}}\x{{0900}}-\x{{0903}}\x{{093A}}-\x{{094F}}]', '', 'g')) AS n_devv
FROM {p}gt g LEFT JOIN {p}rep r USING ({key}) LEFT JOIN {p}dom d USING ({key})"""),
    ]
    cases = {
        "symbol": ("f_symbol", None),
        "repeat": ("m_repeat IS NOT NULL", "m_repeat"),
        "dev_signs": ("m_sig IS NOT NULL", "m_sig"),
        "dev_consonants": ("m_dco IS NOT NULL", "m_dco"),
        "consonants": ("m_con IS NOT NULL", "m_con"),
        "dominance": ("n_ns >= 6 AND top::DOUBLE / n_ns::DOUBLE > 0.45", "printf('%.2f', top::DOUBLE / n_ns::DOUBLE)"),
        "vowels": ("n_let >= 6 AND n_vow::DOUBLE / n_let::DOUBLE < 0.22", "printf('%.2f', n_vow::DOUBLE / n_let::DOUBLE)"),
        "dev_vowels": ("n_dev >= 6 AND n_devv::DOUBLE / n_dev::DOUBLE < 0.10", "printf('%.2f', n_devv::DOUBLE / n_dev::DOUBLE)"),
    }
    cases = {r: (test, said(G.RULE_TEXT[r], *([arg] if arg else []))) for r, (test, arg) in cases.items()}
    active = [r for r in GIB_ALL if r in rules]
    rule = "CASE " + " ".join(f"WHEN {cases[r][0]} THEN '{r}'" for r in active) + " END" if active else "NULL"
    reason = "CASE " + " ".join(f"WHEN {cases[r][0]} THEN {cases[r][1]}" for r in active) + " END" if active else "NULL"
    ctes.append((f"{p}gib", f"SELECT {key}, t, {rule} AS rule, {reason} AS reason FROM {p}ms"))
    return ctes


def classify_ctes(p: str, src: str, key: str, text: str, words, rules=GIB_ALL) -> list[tuple[str, str]]:
    """CTE {p}cls (key, t, verdict, verdict_reason, rule, unsafe_match)."""
    return gibberish_ctes(p, src, key, text, rules) + [(f"{p}cls", f"""SELECT {key}, t, unsafe_match,
  CASE WHEN t = '' THEN 'off_topic' WHEN unsafe_match IS NOT NULL THEN 'unsafe' WHEN rule IS NOT NULL THEN 'off_topic' ELSE 'in_scope' END AS verdict,
  CASE WHEN t = '' THEN {lit(G.REASON_EMPTY)} WHEN unsafe_match IS NOT NULL THEN {said(G.REASON_UNSAFE, 'unsafe_match')}
       WHEN rule IS NOT NULL THEN {said(G.REASON_GIBBERISH, 'reason')} ELSE {lit(G.REASON_PASSED)} END AS verdict_reason,
  CASE WHEN t = '' THEN 'empty' WHEN unsafe_match IS NOT NULL THEN 'unsafe' ELSE rule END AS rule
FROM (SELECT *, {unsafe('t', words)} AS unsafe_match FROM {p}gib) z""")]


def grounding_sql(qsrc: str, qk: str, hits: str, thr: float) -> str:
    t, s4 = f"{thr:.2f}", "printf('%.4f', h.score)"
    return f"""SELECT q.{qk}, (h.score IS NOT NULL AND h.score >= {thr}) AS can_answer, coalesce(h.score, 0.0) AS top_score,
  CASE WHEN h.score IS NULL THEN {lit(G.REASON_NO_CHUNKS)}
       WHEN h.score < {thr} THEN {said(G.REASON_BELOW, s4, lit(t))}
       ELSE {said(G.REASON_ABOVE, s4, lit(t))} END AS reason
FROM {qsrc} q LEFT JOIN (SELECT * FROM {hits} WHERE rank = 1) h ON q.{qk} = h.{qk}"""


# ---------------------------------------------------------------------------- generation / verify
def refusal(x: str, phrases=REFUSAL_PHRASES) -> str:
    arr = "[" + ", ".join("'" + ph.replace("'", "''") + "'" for ph in phrases) + "]"
    return f"(len(list_filter({arr}, lambda p_: contains(lower({x}), p_))) > 0)"


def extractive_ctes(p: str, qsrc: str, qk: str, qt: str, hits: str) -> list[tuple[str, str]]:
    """CTE {p}raw (qk, answer) - the built-in extractive generator."""
    return [
        (f"{p}qt", f"SELECT DISTINCT {qk}, unnest({terms(qt)}) AS term FROM {qsrc}"),
        (f"{p}hs", f"""SELECT {qk}, rank, unnest(arr) AS s, unnest(range(len(arr))) AS sp
FROM (SELECT {qk}, rank, {chunk_sents('text')} AS arr FROM {hits}) z"""),
        (f"{p}st", f"SELECT DISTINCT {qk}, rank, sp, unnest({terms('s')}) AS term FROM {p}hs"),
        (f"{p}ov", f"SELECT st.{qk}, st.rank, st.sp, count(*) AS ov FROM {p}st st JOIN {p}qt q ON st.{qk} = q.{qk} AND st.term = q.term GROUP BY st.{qk}, st.rank, st.sp"),
        (f"{p}best", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {qk}, rank ORDER BY ov DESC, sp) AS r FROM {p}ov) z WHERE r = 1"),
        (f"{p}tg", f"""SELECT b.{qk}, b.rank, CASE WHEN regexp_matches(h.s, '[.!?।॥]$')
  THEN substr(h.s, 1, length(h.s) - 1) || ' [' || CAST(b.rank AS VARCHAR) || ']' || substr(h.s, length(h.s), 1)
  ELSE h.s || ' [' || CAST(b.rank AS VARCHAR) || ']' END AS t
FROM {p}best b JOIN {p}hs h ON b.{qk} = h.{qk} AND b.rank = h.rank AND b.sp = h.sp"""),
        (f"{p}raw", f"""SELECT q.{qk}, coalesce(a.answer, '') AS answer FROM {qsrc} q
LEFT JOIN (SELECT {qk}, string_agg(t, ' ' ORDER BY rank) AS answer FROM {p}tg GROUP BY {qk}) a ON q.{qk} = a.{qk}"""),
    ]


def citation_ctes(p: str, asrc: str, qk: str, text: str, hits: str, rank: str = "rank", cid: str = "chunk_id") -> list[tuple[str, str]]:
    """CTE {p}cit (qk, raw, refusal, final_text, citations '|'-joined, n_cited)."""
    parts = (rf"list_transform(flatten(list_transform(regexp_extract_all(raw, '\[([\d,\s]+)\]', 1), lambda g_: string_split(g_, ','))), "
             f"lambda x_: {norm_digits(strip('x_'))})")
    nums = f"list_transform(list_filter({parts}, lambda x_: regexp_full_match(x_, '[0-9]+')), lambda x_: TRY_CAST(x_ AS INTEGER))"
    return [
        (f"{p}n", f"SELECT {qk}, count(*) AS n FROM {hits} GROUP BY {qk}"),
        (f"{p}a0", f"""SELECT a.{qk}, a.{text} AS raw, coalesce(n.n, 0) AS n,
  list_filter({nums}, lambda x_: x_ IS NOT NULL AND x_ >= 1 AND x_ <= coalesce(n.n, 0)) AS v
FROM {asrc} a LEFT JOIN {p}n n ON a.{qk} = n.{qk}"""),
        (f"{p}a1", f"""SELECT {qk}, raw, list_filter(v, lambda x_, i_: list_position(v, x_) = i_) AS ranks, {refusal('raw')} AS refusal FROM {p}a0"""),
        (f"{p}a2", f"""SELECT {qk}, raw, refusal, CASE WHEN refusal OR len(ranks) = 0 THEN {clean('raw')} ELSE raw END AS final_text,
  CASE WHEN refusal OR len(ranks) = 0 THEN [] ELSE ranks END AS ranks FROM {p}a1"""),
        (f"{p}ids", f"""SELECT e.{qk}, string_agg(h.{cid}, '|' ORDER BY e.i) AS citations, count(*) AS n_cited FROM
  (SELECT {qk}, unnest(ranks) AS rk, unnest(range(len(ranks))) AS i FROM {p}a2) e JOIN {hits} h ON e.{qk} = h.{qk} AND e.rk = h.{rank}
GROUP BY e.{qk}"""),
        (f"{p}cit", f"""SELECT a.{qk}, a.raw, a.refusal, a.final_text, coalesce(i.citations, '') AS citations, coalesce(i.n_cited, 0)::BIGINT AS n_cited
FROM {p}a2 a LEFT JOIN {p}ids i ON a.{qk} = i.{qk}"""),
    ]


def verify_ctes(p: str, asrc: str, qk: str, text: str, hits: str, rank: str = "rank", htext: str = "text",
                cid: str = "chunk_id", decimals: bool = False, grouped: bool = False) -> list[tuple[str, str]]:
    """CTEs {p}claims (qk, sent_no, claim, tagged) and {p}flags (qk, sent_no, claim, citation_index, chunk_id, reason)."""
    tag, tail = (r"\[\d[\d,\s]*\]" if grouped else r"\[\d+\]"), (r"(\.[0-9]+)?" if decimals else "")
    notags = rf"regexp_replace({norm_digits('sentence')}, '{tag}', '', 'g')"
    claims = rf"list_distinct(list_filter(regexp_extract_all({notags}, '[\p{{L}}\p{{N}}_]+{tail.replace('(', '(?:')}'), lambda w_: regexp_full_match(w_, '[0-9]+{tail}')))"
    idx = "CAST(c.citation_index AS VARCHAR)"
    numbers = r"regexp_extract_all(sentence, '\[(\d+)\]', 1)"
    if grouped:
        numbers = r"regexp_extract_all(array_to_string(regexp_extract_all(sentence, '\[(\d[\d,\s]*)\]', 1), ' '), '\d+')"
    tags = f"list_distinct(list_transform({numbers}, lambda x_: TRY_CAST({norm_digits('x_')} AS BIGINT)))"
    whole, sentence = strip(text), "unnest(arr)"
    if decimals:  # twice: a digit may stand between two points
        for _ in range(2):
            whole = rf"regexp_replace({whole}, '([0-9])\.([0-9])', '\1{VER.POINT}\2', 'g')"
        sentence = f"replace(unnest(arr), '{VER.POINT}', '.')"
    return [
        (f"{p}vs", f"""SELECT {qk}, {sentence} AS sentence, unnest(range(len(arr)))::INT AS sent_no
FROM (SELECT {qk}, {verify_sents(whole)} AS arr FROM {asrc}) z"""),
        (f"{p}vt", f"SELECT {qk}, sent_no, {tags} AS tags, {claims} AS claims FROM {p}vs"),
        (f"{p}claims", f"SELECT {qk}, sent_no, unnest(claims) AS claim, len(tags) > 0 AS tagged, tags FROM {p}vt WHERE len(claims) > 0"),
        (f"{p}hn", f"SELECT {qk}, {rank}::BIGINT AS citation_index, {cid} AS chunk_id, {norm_digits(htext)} AS ht FROM {hits}"),
        (f"{p}cited", f"""SELECT c.{qk}, c.sent_no, c.claim, c.citation_index, h.chunk_id,
  CASE WHEN h.ht IS NULL THEN {said(VER.REASON_NO_CHUNK, idx)} ELSE {said(VER.REASON_NOT_IN_CITED, 'c.claim', idx, 'h.chunk_id')} END AS reason
FROM (SELECT {qk}, sent_no, claim, unnest(tags) AS citation_index FROM {p}claims WHERE tagged) c
LEFT JOIN {p}hn h ON c.{qk} = h.{qk} AND c.citation_index = h.citation_index
WHERE h.ht IS NULL OR NOT contains(h.ht, c.claim)"""),
        (f"{p}uncited", f"""SELECT c.{qk}, c.sent_no, c.claim, NULL::BIGINT AS citation_index, NULL::VARCHAR AS chunk_id,
  {said(VER.REASON_NOT_IN_ANY, 'c.claim')} AS reason
FROM {p}claims c WHERE NOT c.tagged AND NOT EXISTS (SELECT 1 FROM {p}hn h WHERE h.{qk} = c.{qk} AND contains(h.ht, c.claim))"""),
        (f"{p}flags", f"SELECT * FROM {p}cited UNION ALL SELECT * FROM {p}uncited"),
    ]
