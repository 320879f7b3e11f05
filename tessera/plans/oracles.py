"""DuckDB SQL of the registered queries, built from shared common table expressions."""

from __future__ import annotations

from tessera.functions.text import LEGAL_PATTERN, LETTERS, LOOK_ALIKE, SOUNDS, STREET_WORDS
from tessera.operators.features import PLAIN
from tessera.operators.learning import INTERCEPT, LINEAR
from tessera.operators.matching import BUDGET_GRID, BUDGETS, CHANNELS, COARSE, EXACT, LINKS_PER_ENTITY, MARGINS, TUNED
from tessera.sources.records import ADDRESS, MADE, NAME, business_sql, noise_sql


def _map(entries: dict[str, str]) -> str:
    return "map {" + ", ".join(f"'{k}': '{v}'" for k, v in entries.items()) + "}"


def _fold(x: str) -> str:
    return f"case when regexp_matches({x}, '[^\\x00-\\x7f]') then array_to_string(list_transform(string_split(lower({x}), ''), lambda c: coalesce({_map(LETTERS)}[c], c)), '') else lower({x}) end"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def _collapse(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 or c <> substr({x}, i - 1, 1)), '')"


def _nested(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_MADE = MADE.replace("'$1o')", "'\\1o', 'g')")
_FIELDS = lambda key, kind: ", ".join(f"{x} as {c}" for c, x in business_sql(key, kind, _MADE.format(key)).items())
_NAME_NOISE, _ADDRESS_NOISE = noise_sql(f"regexp_replace({NAME}, '[aeiou]', '', 'g')", f"regexp_replace({NAME}, '([lnrst])', '\\1\\1', 'g')")

RAW = f"""
cust as (select c_custkey as key, coalesce(n_name, 'none') as country, {_FIELDS("c_custkey", "lower(coalesce(c_mktsegment, ''))")} from customer left join part on c_custkey = p_partkey left join nation on c_nationkey = n_nationkey),
supp as (select s_suppkey as key, coalesce(n_name, 'none') as country, {_FIELDS("s_suppkey", "'supply'")} from supplier left join part on s_suppkey = p_partkey left join nation on s_nationkey = n_nationkey),
noise0 as (select c.*, o_orderkey as noise, o_orderkey % 2 + 2 as tier, c.key as owner, o_orderkey::varchar as id from orders o join cust c on c.key = o.o_custkey
  union all by name select *, key as noise, 3 as tier, null::bigint as owner, 'U' || key as id from supp),
noise1 as (select *, noise % 20 + 1 as nudge from noise0),
raw as (select 'S1_' || key as entity_id, {NAME} as business_name, {ADDRESS} as business_address, ' ' || country || ' ' as country, 1::int as tier, key as owner from cust
  union all select 'S' || tier || '_' || id, {_NAME_NOISE}, {_ADDRESS_NOISE}, country, tier::int, owner from noise1)"""

REC = RAW + f""",
folded as (select *, {_fold("business_name")} as fn, {_fold("business_address")} as fa from raw),
named as (select entity_id, tier, owner, lower(regexp_replace(country, '^\\s+|\\s+$', '', 'g')) as country_norm, {_squeeze("regexp_replace(fn, '[^a-z0-9]', ' ', 'g')")} as name_alnum,
  {_squeeze("regexp_replace(fa, '[^a-z0-9]', ' ', 'g')")} as addr_alnum, regexp_extract_all(business_address, '\\p{{Nd}}+') as g from folded),
cored as (select *, {_squeeze(f"regexp_replace(name_alnum, '{LEGAL_PATTERN}', ' ', 'g')")} as cut from named),
rec as (select entity_id, tier, owner, country_norm, name_alnum, case when cut = '' then name_alnum else cut end as name_core, addr_alnum,
  array_to_string(list_transform(list_filter(string_split(addr_alnum, ' '), lambda t: t <> ''), lambda t: coalesce({_map(STREET_WORDS)}[t], t)), ' ') as addr_street,
  g[1] as house_number, list_filter(g, lambda x: length(x) in (5, 6))[-1] as postal_code, array_to_string(g, ' ') as digits from cored)"""

#: Skeletons of the distinct words of the records: tok, k3 (phonetic), k4 (joint).
SKEL = f"""
toks as (select distinct unnest(string_split(name_alnum || ' ' || addr_alnum || ' ' || addr_street, ' ')) as tok from rec),
k1 as (select tok, case when regexp_matches(tok, '[0-9]') and not regexp_matches(tok, '^[0-9]+$') then translate(tok, '{LOOK_ALIKE[0]}', '{LOOK_ALIKE[1]}') else tok end as s from toks where tok <> ''),
k2 as (select tok, {_nested("s", SOUNDS)} as s from k1),
k3a as (select tok, {_collapse('s')} as s from k2),
k3b as (select tok, regexp_replace(s, '^[aeiou]', 'a') as s from k3a),
k3c as (select tok, substr(s, 1, 1) || regexp_replace(substr(s, 2), '[aeiouyh]', '', 'g') as s from k3b),
k4a as (select tok, {_collapse('tok')} as s from toks where tok <> ''),
skel as (select k3c.tok, {_collapse('k3c.s')} as k3, substr(k4a.s, 1, 1) || regexp_replace(substr(k4a.s, 2), '[aeiouyhw]', '', 'g') as k4 from k3c join k4a on k3c.tok = k4a.tok)"""

_NUM = "case when regexp_matches({0}, '^0+$') then '0' else ltrim({0}, '0') end"
_GRAMS = "select distinct entity_id, country_norm, unnest(list_transform(range(1, greatest(1, length(s) - 4) + 1), lambda i: substr(s, i, 5))) as tok from (select *, replace({0}, ' ', '') as s from rec) where s <> ''"

#: Tokens of each record: name words, address places, numbers, and those of the channels.
WORDS = f"""
name_w as (select entity_id, country_norm, unnest(string_split(name_core, ' ')) as tok from rec),
name_k as (select distinct w.entity_id, w.country_norm, s.k3 as k, s.k4 from name_w w join skel s on w.tok = s.tok where length(w.tok) > 1),
addr_l as (select entity_id, country_norm, list_filter(string_split(addr_street, ' '), lambda x: x <> '') as l from rec),
addr_w as (select entity_id, country_norm, unnest(l) as tok, generate_subscripts(l, 1) as i from addr_l),
addr_u as (select w.*, s.k3, case when regexp_matches(w.tok, '^[0-9]+$') then {_NUM.format("w.tok")} when regexp_matches(w.tok, '^[a-z]+$') then s.k3 else w.tok end as u
  from addr_w w join skel s on w.tok = s.tok),
nums as (select distinct entity_id, country_norm, {_NUM.format("x")} as num from (select entity_id, country_norm, unnest(regexp_extract_all(addr_street, '[0-9]+')) as x from rec)),
tok4 as (
  select entity_id, country_norm, 'n:' || k as tok from name_k
  union select entity_id, country_norm, 'a:' || k3 from addr_u where regexp_matches(tok, '^[a-z]+$') and length(tok) > 1
  union select entity_id, country_norm, 'c:' || tok from addr_u where not regexp_matches(tok, '^[a-z]+$') and not regexp_matches(tok, '^[0-9]+$')
  union select entity_id, country_norm, 'd:' || num from nums
  union select a.entity_id, a.country_norm, 'b:' || a.u || '_' || b.u from addr_u a join addr_u b on a.entity_id = b.entity_id and b.i = a.i + 1
  union select a.entity_id, a.country_norm, 'p:' || a.k || '_' || b.k from name_k a join name_k b on a.entity_id = b.entity_id and a.k < b.k),
jtok as (select entity_id, country_norm, 'n:' || k4 as tok from name_k union select entity_id, country_norm, 'a:' || tok from addr_w),
ntok as ({_GRAMS.format("name_core")}),
gtok as ({_GRAMS.format("addr_street")}),
wtok as (select distinct entity_id, country_norm, tok from addr_w)"""

KEYS = """
keyed as (select r.entity_id, r.country_norm, r.tier, coalesce(k.key, '') as name_key, coalesce(k.key, '') || '#' || coalesce(n.nums, '') as twin_key
  from rec r left join (select entity_id, string_agg(k, ' ' order by k) as key from (select distinct entity_id, k from name_k) group by entity_id) k on k.entity_id = r.entity_id
  left join (select entity_id, string_agg(num, ' ' order by num) as nums from nums group by entity_id) n on n.entity_id = r.entity_id)"""

ALL = ",".join([REC, SKEL, WORDS])
_TABLE = {"D": "ntok", "E": "wtok", "F": "gtok", "J": "jtok", "R": "tok4"}


def _of(value: str) -> str:
    return "case t.channel " + " ".join(f"when '{c.name}' then {getattr(c, value)!r}" for c in CHANNELS) + " end"


TOKENS = ALL + ",\ntokens as (" + " union all ".join(f"select '{c}' as channel, t.country_norm as country, case when r.tier = 1 then 's' else 'r' end as side, t.entity_id as id, t.tok from {x} t join rec r on r.entity_id = t.entity_id" for c, x in _TABLE.items()) + ")"
INDEX = TOKENS + f""",
sizes as (select country_norm as country, case when tier = 1 then 's' else 'r' end as side, count(*) as n from rec group by 1, 2),
voc as (select t.channel, t.country, t.tok, count(*) as df, ln(1 + any_value(z.n) / (1 + count(*))) as idf, count(*) <= least(50000, greatest(20, floor(any_value(z.n) * {_of("df_frac")}::double))) as indexable
  from tokens t join sizes z on z.country = t.country and z.side = t.side where t.side <> {_of("asked")} group by t.channel, t.country, t.tok)"""
FOUND = INDEX + f""",
weighted as (select t.*, v.df, v.idf, v.indexable, sqrt(sum(v.idf * v.idf) over (partition by t.channel, t.country, t.side, t.id)) as norm from tokens t join voc v on v.channel = t.channel and v.country = t.country and v.tok = t.tok),
asked as (select * from (select t.*, row_number() over (partition by channel, country, id order by df, tok) as r from weighted t where indexable and side = {_of("asked")}) t where r <= {_of("query_tokens")}),
sums as (select t.channel, t.country, a.id as q, t.id as d, sum(a.idf * a.idf) as s, any_value(a.norm) as qn, any_value(t.norm) as dn
  from asked a join weighted t on t.channel = a.channel and t.country = a.country and t.tok = a.tok and t.side <> a.side group by 1, 2, 3, 4),
scores as (select channel, country, q, d, round(s / (qn * dn), 6) as score from sums),
found as (select channel, country, q, d, score, r - 1 as rank from (select *, row_number() over (partition by channel, country, q order by score desc, d) as r from scores) t where r <= {_of("k")})"""
LINKS = FOUND + f""",
links as (select country, q as rec_id, d as s1_id, score, rank,
  round(case when rank = 0 then score - coalesce(max(case when rank = 1 then score end) over w, 0) else score - max(score) over w end, 6) as margin
  from found where channel = 'R' window w as (partition by country, q)),
capped as (select country, rec_id, s1_id, score, rank, margin from (select *, row_number() over (partition by country, s1_id order by score desc, rec_id) as n from links) where n <= {LINKS_PER_ENTITY})"""

_SORTED = "array_to_string(list_sort(list_filter(string_split({0}.name_core, ' '), lambda t: t <> '')), ' ')"
BLOCK_KEYS = {"exact_name": "{0}.name_alnum", "core": "{0}.name_core", "sorted": _SORTED, "postal_house": "({0}.postal_code || '|' || {0}.house_number)"}


def block(key: str) -> str:
    return f"select a.country_norm as country, a.entity_id as s1_id, b.entity_id as rec_id from rec a join rec b on a.country_norm = b.country_norm and a.tier = 1 and b.tier > 1 and {key.format('a')} = {key.format('b')} and {key.format('a')} <> ''"


def union_of(names: str) -> str:
    """CTEs evid and cand from the exact keys, the named channels and the capped links."""
    columns = [*EXACT, *[f"{n.lower()}_{c}" for n in "DEFJ" for c in ("score", "rank")], "r_score", "r_rank", "r_margin"]
    row = lambda given: ", ".join(f'{given.get(c, "null::double")} as "{c}"' for c in columns)
    parts = [f"select country, s1_id, rec_id, {row({flag: '1::double'})} from ({block(BLOCK_KEYS[kind])})" for flag, kind in EXACT.items()]
    parts += [f"select country, q, d, {row({f'{n.lower()}_score': 'score', f'{n.lower()}_rank': 'rank::double'})} from found where channel = '{n}'" for n in names]
    parts.append(f"select country, s1_id, rec_id, {row({'r_score': 'score', 'r_rank': 'rank::double', 'r_margin': 'margin'})} from capped")
    most = ", ".join(f'max("{c}") as "{c}"' for c in columns)
    return f"evid as ({' union all '.join(parts)}),\ncand as (select country, s1_id, rec_id, {most} from evid group by 1, 2, 3)"


_JW = "round(case when {0} = '' or {1} = '' then 0 else jaro_winkler_similarity({0}, {1}) end, 6)"
_SIDE = lambda p, t: ", ".join(f"coalesce({t}.{c}, '') as {p}_{c}" for c in ("name_alnum", "name_core", "addr_street", "house_number", "postal_code"))
RANKED = LINKS + ",\n" + union_of("DEJ") + f""",
texts as (select c.*, {_SIDE("q", "a")}, {_SIDE("c", "b")} from cand c join rec a on a.entity_id = c.s1_id join rec b on b.entity_id = c.rec_id),
simmed as (select *, {_JW.format("q_name_core", "c_name_core")} as name_sim, {_JW.format("q_addr_street", "c_addr_street")} as addr_sim,
  (q_name_core <> '' and q_name_core = c_name_core)::int as exact_name, (q_house_number <> '' and q_house_number = c_house_number)::int as house_match, (q_postal_code <> '' and q_postal_code = c_postal_code)::int as postal_match,
  {" + ".join(f'("{c}" is not null)::int' for c in (*EXACT, "d_score", "e_score", "f_score", "j_score"))} as n_channels from texts),
ranked as (select *, round(2 * name_sim + 2 * addr_sim + 1.5::double * exact_name + 0.8::double * n_channels + house_match + postal_match
  + 0.5::double * coalesce(d_score, 0) + 0.5::double * coalesce(e_score, 0) + 1.5::double * coalesce(j_score, 0), 7) as rank_score from simmed),
tiered0 as (select *, row_number() over w as rn, first_value({{'e': exact_name, 'n': name_sim, 'a': addr_sim, 'p': postal_match, 'h': house_match}}) over w as top_one,
  coalesce(d_rank < 5, false) or coalesce(e_rank < 5, false) or coalesce(j_rank < 12, false) or r_score is not null as protected from ranked window w as (partition by country, s1_id order by rank_score desc, rec_id)),
tiered as (select *, case when top_one.e = 1 and (top_one.a > 0.8 or top_one.p = 1 or top_one.h = 1) then 0 when top_one.e = 1 or top_one.n > 0.92 then 1 when top_one.n > 0.75 or top_one.a > 0.85 then 2 else 3 end as tier from tiered0),
compressed as (select *, {list(BUDGETS)}[tier + 1] as budget from tiered where protected or rn <= {list(BUDGETS)}[tier + 1])"""

_LIST = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
_UNION = lambda a, b: f"len(list_distinct(list_concat({a}, {b})))"
_BOTH = lambda a, b: f"case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / {_UNION(a, b)} end"
_CONTAINED = lambda a, b: f"case when len({a}) = 0 or len({b}) = 0 then 0 else len(list_intersect({a}, {b})) / least(len({a}), len({b})) end"
_JACCARD = lambda a, b: f"case when len({a}) + len({b}) = 0 then -1 else len(list_intersect({a}, {b})) / {_UNION(a, b)} end"
_KIND = lambda x, k: f"list_filter({x}, lambda t: starts_with(t, '{k}:'))"
_DIGITS = lambda x: f"list_filter({x}, lambda t: regexp_matches(t, '^[0-9]+$'))"
_LENGTHS = lambda a, b: f"case when {a} = '' or {b} = '' then 0 else least(length({a}), length({b})) / greatest(length({a}), length({b})) end"
_LESS = lambda a, b: f"list_filter({a}, lambda t: not list_contains({b}, t))"
_SAME = lambda c: f"q_{c} <> '' and q_{c} = c_{c}"

_VALUES = {
    "n_exact_alnum": _SAME("name_alnum"), "n_exact_core": _SAME("name_core"), "n_exact_compact": "q_name_core <> '' and replace(q_name_core, ' ', '') = replace(c_name_core, ' ', '')",
    "n_sorted_eq": "len(qn) > 0 and list_sort(qn) = list_sort(cn)", "n_jaro_winkler": "jn",
    "n_lev_norm": "case when q_name_core = '' or c_name_core = '' then 0 else 1 - levenshtein(q_name_core, c_name_core) / greatest(length(q_name_core), length(c_name_core)) end",
    "n_prefix4": "q_name_core <> '' and substr(q_name_core, 1, 4) = substr(c_name_core, 1, 4)", "n_len_ratio": _LENGTHS("q_name_core", "c_name_core"),
    "n_tok_jaccard": _BOTH("qn", "cn"), "n_tok_containment": _CONTAINED("qn", "cn"), "n_rare_tok_overlap": "0",
    "a_exact": _SAME("addr_street"), "a_jaro_winkler": "ja", "a_tok_jaccard": _BOTH("qa", "ca"), "a_tok_containment": _CONTAINED("qa", "ca"), "a_len_ratio": _LENGTHS("q_addr_street", "c_addr_street"),
    "a_house_match": _SAME("house_number"), "a_postal_match": _SAME("postal_code"), "a_digit_jaccard": _BOTH(_DIGITS("qa"), _DIGITS("ca")), "a_digit_overlap_n": f"len(list_intersect({_DIGITS('qa')}, {_DIGITS('ca')}))",
    "a_missing_q": "q_addr_street = ''", "a_missing_c": "c_addr_street = ''",
    "x_name_x_addr": "jn * ja", "x_name_plus_addr": "jn + ja", "x_both_strong": "jn > 0.90 and ja > 0.85", "x_either_strong": "jn > 0.90 or ja > 0.85",
    "r_n_channels": "n_channels", "r_exact_hash_hit": 'coalesce("A", "B", "C") is not null', "r_d_score": "coalesce(d_score, 0)", "r_d_rank": "coalesce(d_rank, 999)", "r_e_score": "coalesce(e_score, 0)", "r_e_rank": "coalesce(e_rank, 999)",
    "r_g_hit": '"G" is not null', "r_rank_score": "rank_score", "r_cand_set_size": "count(*) over own", "r_score_margin_top": "rank_score - max(rank_score) over own", "r_is_top1": "row_number() over (partition by country, s1_id order by rank_score desc, rec_id) = 1",
    "s_is_s3": "starts_with(rec_id, 'S3')", "r_j_score": "coalesce(j_score, 0)", "r_j_rank": "coalesce(j_rank, 999)",
    "rv_hit": "r_score is not null", "rv_score": "coalesce(r_score, 0)", "rv_rank": "coalesce(r_rank, 99)", "rv_margin": "coalesce(r_margin, -1)", "rv_is_top1": "coalesce(r_rank = 0, false)",
    **{f"k_{n}_jac": _JACCARD(_KIND("qt", k), _KIND("ct", k)) for n, k in (("name", "n"), ("addr", "a"), ("bigram", "b"))},
    **{f"k_{n}_shared": f"len(list_intersect({_KIND('qt', k)}, {_KIND('ct', k)}))" for n, k in (("bigram", "b"), ("namepair", "p"), ("code", "c"))},
    "k_all_jac": _JACCARD("qt", "ct"), "k_num_jac": _JACCARD("qd", "cd"), "k_num_s1_missing": f"case when len(qd) = 0 then -1 else len({_LESS('qd', 'cd')}) / len(qd) end", "k_num_close": "len(list_filter(qx, lambda i: len(list_filter(cx, lambda j: abs(i::bigint - j::bigint) between 1 and 20)) > 0)) > 0",
    "amb_s1_name_count": "coalesce(q_count, 0)", "amb_rec_name_count": "coalesce(c_count, 0)", "amb_rec_count_if_noaddr": "case when c_addr_street = '' then coalesce(c_count, 0) else 0 end",
    "cor_global_twin": "twins", "cor_local_twin": "count(*) over (partition by country, s1_id, twin) - 1", "cor_name_support": "count(*) over (partition by country, s1_id, c_key) - 1",
    "cor_extra_num_support": f"case when len({_LESS('cd', 'qd')}) = 0 then -1 else coalesce(num_support, 0) end",
}
FEATURES = RANKED + "," + KEYS + f""",
tl as (select entity_id, list(tok) as l from tok4 group by 1),
nl as (select entity_id, list(num) as l from nums group by 1),
name_counts as (select country_norm as country, name_key, count(*) as n from keyed where tier = 1 group by 1, 2),
twin_of as (select entity_id, count(*) over (partition by country_norm, twin_key) - 1 as twins from keyed where tier > 1),
based as (select p.*, coalesce(qt.l, []::varchar[]) as qt, coalesce(ct.l, []::varchar[]) as ct, coalesce(qd.l, []::varchar[]) as qd, coalesce(cd.l, []::varchar[]) as cd,
  {_LIST("q_name_core")} as qn, {_LIST("c_name_core")} as cn, {_LIST("q_addr_street")} as qa, {_LIST("c_addr_street")} as ca, name_sim as jn0, k.twin_key as twin, k.name_key as c_key, qc.n as q_count, cc.n as c_count, w.twins,
  case when q_name_core = '' or c_name_core = '' then 0 else jaro_winkler_similarity(q_name_core, c_name_core) end as jn, case when q_addr_street = '' or c_addr_street = '' then 0 else jaro_winkler_similarity(q_addr_street, c_addr_street) end as ja
  from compressed p left join tl qt on qt.entity_id = p.s1_id left join tl ct on ct.entity_id = p.rec_id left join nl qd on qd.entity_id = p.s1_id left join nl cd on cd.entity_id = p.rec_id
  join keyed kq on kq.entity_id = p.s1_id join keyed k on k.entity_id = p.rec_id left join name_counts qc on qc.country = p.country and qc.name_key = kq.name_key left join name_counts cc on cc.country = p.country and cc.name_key = k.name_key join twin_of w on w.entity_id = p.rec_id),
extra as (select country, s1_id, rec_id, unnest({_LESS("cd", "qd")}) as num from based),
support as (select a.country, a.s1_id, a.rec_id, count(distinct b.rec_id) as num_support from extra a join extra b on a.country = b.country and a.s1_id = b.s1_id and a.num = b.num and a.rec_id <> b.rec_id group by 1, 2, 3),
full_ as (select b.*, num_support, list_filter({_LESS("qd", "cd")}, lambda t: length(t) <= 6) as qx, list_filter({_LESS("cd", "qd")}, lambda t: length(t) <= 6) as cx from based b left join support using (country, s1_id, rec_id)),
feats as (select country, s1_id, rec_id, {", ".join(f"round(({_VALUES[n]})::double, 7) as {n}" for n in PLAIN)} from full_ window own as (partition by country, s1_id))"""
_Z = f"{INTERCEPT}::double + " + " + ".join(f"{w}::double * {n}" for n, w in LINEAR.items())
SCORED = FEATURES + f""",
z as (select country, s1_id, rec_id, {_Z} as z from feats),
scored as (select country, s1_id, rec_id, round(z, 8) as score, round(1 / (1 + exp(-z)), 6) as p from z)"""

TRUTH = """
universe as (select entity_id as s1_id from rec where tier = 1),
truth as (select r.country_norm as country, 'S1_' || r.owner as s1_id, r.entity_id as rec_id from rec r join rec o on o.entity_id = 'S1_' || r.owner and o.tier = 1 and o.country_norm = r.country_norm where r.tier > 1)"""
JUDGED = SCORED + "," + TRUTH

BLENDED = JUDGED + f""",
pair_text as (select c.country, c.s1_id, c.rec_id, c.q_name_alnum || ' ; ' || c.q_addr_street as a, c.c_name_alnum || ' ; ' || c.c_addr_street as b from compressed c join scored s on s.s1_id = c.s1_id and s.rec_id = c.rec_id where s.p between 0.02 and 0.98),
second as (select country, s1_id, rec_id, round(8 * (jaro_winkler_similarity(a, b) - 0.5), 6) as second from pair_text),
blended as (select s.*, t.second, round(case when t.second is not null then 1 / (1 + exp(-(0.679::double * ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) + 0.621::double * t.second))) else p end, 6) as blended
  from scored s left join second t using (country, s1_id, rec_id))"""

_F = "case when n_pred = 0 and n_true = 0 then 1.0 when n_hit = 0 then 0.0 else 1.25 * n_hit / (n_pred + 0.25 * n_true) end"
_T = 0.7


def unique_of(scores: str, p: str = "p") -> str:
    return f"select country, s1_id, rec_id, p from (select country, s1_id, rec_id, {p} as p, row_number() over (partition by country, rec_id order by {p} desc, s1_id) as n from {scores} where {p} >= {_T}) where n = 1"


def counts_of(matches: str) -> str:
    return f""",
matches as ({matches}),
both_ as (select s1_id, rec_id, max(t) as t, max(m) as m from (select s1_id, rec_id, 1 as t, 0 as m from truth union all select s1_id, rec_id, 0, 1 from matches) group by 1, 2),
per as (select s1_id, sum(t)::bigint as n_true, sum(m)::bigint as n_pred, sum(t * m)::bigint as n_hit from both_ group by 1),
counts as (select u.s1_id, coalesce(n_true, 0) as n_true, coalesce(n_pred, 0) as n_pred, coalesce(n_hit, 0) as n_hit from universe u left join per s on s.s1_id = u.s1_id)"""


def lists_of(p: str, scores: str, p_col: str = "p") -> str:
    """CTEs ``{p}pairs`` and ``{p}ents``: flagged pairs, and entities with their number of true matches."""
    return f""",
{p}pairs as (select s.s1_id, s.rec_id, s.{p_col} as p, (t.rec_id is not null)::int as hit, row_number() over (partition by s.country, s.rec_id order by s.{p_col} desc, s.s1_id) = 1 as first, max(s.{p_col}) over (partition by s.s1_id) as top
  from {scores} s left join truth t on t.s1_id = s.s1_id and t.rec_id = s.rec_id),
{p}ents as (select u.s1_id, count(t.rec_id) as n_true, ('0x' || substr(md5(u.s1_id), 1, 8))::bigint % 100 % 2 as fold from universe u left join truth t on t.s1_id = u.s1_id group by 1)"""


def swept(p: str, grid: str, by: str = "") -> str:
    """CTE ``{p}swept`` over a grid CTE of threshold, margin, uni."""
    return f""",
{p}taken as (select g.threshold, g.margin, g.uni, s1_id, count(*) as n_pred, sum(hit) as n_hit from {p}pairs, {grid} g
  where p >= g.threshold and (g.margin is null or p >= round(top - g.margin, 9)) and (not g.uni or first) group by 1, 2, 3, 4),
{p}swept as (select g.threshold, g.margin, g.uni{by}, round(avg({_F.replace("n_pred", "coalesce(t.n_pred, 0)").replace("n_hit", "coalesce(t.n_hit, 0)").replace("n_true", "e.n_true")}), 6) as macro_f05, coalesce(sum(t.n_pred), 0)::bigint as n_pred
  from {grid} g cross join {p}ents e left join {p}taken t on t.s1_id = e.s1_id and t.threshold = g.threshold and t.margin is not distinct from g.margin and t.uni = g.uni group by g.threshold, g.margin, g.uni{by})"""


def grid_of(name: str, rules) -> str:
    return f",\n{name} as (select * from (values " + ", ".join(f"({t}::double, {'null' if m is None else m}::double, {str(u).lower()})" for t, m, u in rules) + ") as v(threshold, margin, uni))"


def with_(ctes: str, body: str) -> str:
    return f"with {ctes} {body}"


def _share(q: float) -> str:
    return f"max(case when r = least(n, floor({q}::double * n) + 1) then n_pred end)"


_COUNTS = JUDGED + counts_of(unique_of("scored"))
_MARGIN_GRID = [(t, mg, False) for mg in MARGINS for t in COARSE]
_GATE = grid_of("tuned", TUNED) + lists_of("a_", "scored") + lists_of("b_", "blended", "blended") + swept("a_", "tuned", ", e.fold") + swept("b_", "tuned", ", e.fold")
_TOKENS = "select country, id, tok from tokens where channel = '{0}'"
_TOP = "select country, q as s1_id, d as rec_id, score, rank from found where channel = '{0}'"
_FEATS = lambda *prefix: with_(FEATURES, "select s1_id, rec_id, " + ", ".join(n for n in PLAIN if n.split("_")[0] in prefix) + " from feats")
_BUCKET = "('0x' || substr(md5({0}), 1, 8))::bigint % 100"
_EACH_BUDGET = " union all ".join(f"select '{'/'.join(map(str, b))}' as budgets, s1_id, rec_id from tiered where protected or rn <= {list(b)}[tier + 1]" for b in BUDGET_GRID)

ORACLE_SQL = {
    "raw_records": with_(RAW, "select entity_id, business_name, business_address, country, tier, owner from raw"),
    "norm_record": with_(REC, "select entity_id, country_norm, name_alnum, name_core, addr_alnum, addr_street, house_number, postal_code, digits from rec"),
    "legal_suffix": with_(REC, "select name_alnum, name_core, count(*) as n from rec where name_core <> name_alnum group by 1, 2"),
    "street_abbrev": with_(REC, "select entity_id, addr_alnum, addr_street from rec where addr_alnum <> addr_street"),
    "digit_groups": with_(REC, "select entity_id, (generate_subscripts(l, 1) - 1)::int as place, unnest(l) as digit_group from (select entity_id, string_split(digits, ' ') as l from rec where digits <> '')"),
    "countries": with_(REC, "select distinct country_norm from rec"),
    "country_corpus": with_(REC, "select country_norm, count(*) as n, count(distinct postal_code) as n_postal from rec where tier > 1 and country_norm in ('nation_3', 'nation_7') group by 1"),
    "phonetic_skeleton": with_(REC + "," + SKEL, "select tok, k3 as skeleton from skel"),
    "joint_skeleton": with_(REC + "," + SKEL, "select tok, k4 as skeleton from skel"),
    **{f"{n}_tokens": with_(TOKENS, _TOKENS.format(c)) for n, c in (("tok4", "R"), ("joint", "J"), ("addr_word", "E"), ("addr_ngram", "F"))},
    "char_ngrams_df": with_(TOKENS, "select country, tok, count(*) as df from tokens where channel = 'D' group by 1, 2"),
    "url_tokens": "select tok, count(*) as df from (select distinct page_id, unnest(list_filter(string_split(regexp_replace(lower(url), '[^a-z0-9]', ' ', 'g'), ' '), lambda t: t <> '')) as tok from pages) group by 1",
    "name_key_counts": with_(ALL + "," + KEYS, "select country_norm as country, name_key, count(*) as n from keyed group by 1, 2"),
    "twin_counts": with_(ALL + "," + KEYS, "select entity_id, twin_key, count(*) over (partition by country_norm, twin_key) - 1 as twins from keyed"),
    **{f"block_{k}": with_(REC, block(v)) for k, v in BLOCK_KEYS.items()},
    "block_sizes": with_(REC, "select country_norm as country, name_core as key, sum((tier = 1)::int)::bigint as n_s1, sum((tier > 1)::int)::bigint as n_rec, (sum((tier = 1)::int) * sum((tier > 1)::int))::bigint as n_pairs from rec where name_core <> '' group by 1, 2 having n_s1 > 0 and n_rec > 0"),
    "idf_vocab": with_(INDEX, "select channel, country, tok, df, round(idf, 6) as idf, indexable from voc"),
    "index_stats": with_(INDEX, "select channel, country, count(*) as n_tokens, sum(df)::bigint as n_postings, sum(indexable::int)::bigint as n_indexable, max(df) as max_df from voc group by 1, 2"),
    **{f"topk_{n}": with_(FOUND, _TOP.format(c)) for n, c in (("name_ngram", "D"), ("addr_word", "E"), ("addr_ngram", "F"), ("joint", "J"))},
    "reverse_top3": with_(LINKS, "select * from links"),
    "reverse_capped": with_(LINKS, "select * from capped"),
    "reverse_counts": with_(LINKS, "select country, s1_id, count(*) as n from capped group by 1, 2"),
    "candidate_union": with_(LINKS + ",\n" + union_of("DEJ"), "select * from cand"),
    "candidate_union_all": with_(LINKS + ",\n" + union_of("DEFJ"), "select * from cand"),
    "sim_jaro_winkler": with_(RANKED, "select s1_id, rec_id, name_sim as sim from compressed"),
    "sim_levenshtein": with_(RANKED, "select s1_id, rec_id, levenshtein(q_name_core, c_name_core)::bigint as distance, round(case when q_name_core = '' or c_name_core = '' then 0 else 1 - levenshtein(q_name_core, c_name_core) / greatest(length(q_name_core), length(c_name_core)) end, 6) as sim from compressed"),
    "cheap_rank": with_(RANKED, "select country, s1_id, rec_id, name_sim, addr_sim, exact_name, house_match, postal_match, n_channels, rank_score from ranked"),
    "compress_adaptive": with_(RANKED, "select country, s1_id, rec_id, rank_score, rn, budget::bigint as budget, protected from compressed"),
    "candidate_pairs": with_(RANKED, "select r.entity_id as source1_entity_id, coalesce(string_agg(distinct c.rec_id, ',' order by c.rec_id), '') as candidate_entity_ids from rec r left join compressed c on c.s1_id = r.entity_id where r.tier = 1 group by 1"),
    "budget_sweep": with_(RANKED + "," + TRUTH + f""",
kept as ({_EACH_BUDGET}), settings as (select distinct budgets from kept),
per as (select g.budgets, u.s1_id, count(k.rec_id) as n_pred, count(t.rec_id) as n_hit from settings g cross join universe u left join kept k on k.s1_id = u.s1_id and k.budgets = g.budgets left join truth t on t.s1_id = k.s1_id and t.rec_id = k.rec_id group by 1, 2),
placed as (select *, row_number() over (partition by budgets order by n_pred, s1_id) as r, count(*) over (partition by budgets) as n from per),
out_ as (select budgets, round(sum(n_hit) / (select count(*) from truth), 6) as recall, round(avg(n_pred), 6) as avg_candidates, {_share(0.95)} as p95 from placed group by 1),
ok as (select *, recall >= max(recall) over () - 0.005 as viable from out_)""", "select budgets, recall, avg_candidates, p95, viable and row_number() over (partition by viable order by avg_candidates, budgets) = 1 as chosen from ok"),
    "candidate_metrics": with_(RANKED + "," + TRUTH + counts_of("select s1_id, rec_id from compressed") + ", o as (select *, row_number() over (order by n_pred, s1_id) as r, count(*) over () as n from counts)",
        f"""select sum(n_hit)::bigint as n_hit, sum(n_true)::bigint as n_true, sum(n_pred)::bigint as n_pairs, round(sum(n_hit) / sum(n_true), 6) as recall, round(sum(n_hit) / sum(n_pred), 6) as precision, round(avg(n_pred), 6) as avg_size, max(n_pred) as max_size,
        sum((n_pred = 0)::int)::bigint as n_empty, {_share(0.5)} as median, {_share(0.9)} as p90, {_share(0.95)} as p95, {_share(0.99)} as p99, round(1 - sum(n_pred) / (count(*) * (select count(*) from rec where tier > 1)), 9) as reduction_ratio from o"""),
    "feat_name": _FEATS("n"), "feat_address": _FEATS("a", "x"), "feat_retrieval": _FEATS("r", "rv", "s"), "feat_phonetic": _FEATS("k"), "feat_corroboration": _FEATS("amb", "cor"),
    "split_buckets": with_(REC, f"select entity_id, ({_BUCKET.format('entity_id')})::int as bucket, {_BUCKET.format('entity_id')} < 5 as held_out from rec"),
    "split_files": with_(REC, f"select case when {_BUCKET.format('entity_id')} < 5 then 'val' else 'train' end as split, count(*) as n, min(entity_id) as first_id from rec where tier = 1 group by 1"),
    "first_queries": with_(REC, "select country_norm, entity_id from (select *, row_number() over (partition by country_norm order by entity_id) as n from rec where tier = 1) where n <= 10"),
    "truth_in_corpus": with_(REC + "," + TRUTH, "select * from truth"),
    "training_truth": with_(REC + "," + TRUTH, f"select * from truth where {_BUCKET.format('s1_id')} >= 5"),
    "label_pairs": with_(RANKED + "," + TRUTH, "select c.s1_id, c.rec_id, (t.rec_id is not null)::int as label from compressed c left join truth t on t.s1_id = c.s1_id and t.rec_id = c.rec_id"),
    "positive_rate": with_(RANKED + "," + TRUTH, "select c.country, count(*) as n, round(avg((t.rec_id is not null)::int), 6) as positive_rate from compressed c left join truth t on t.s1_id = c.s1_id and t.rec_id = c.rec_id group by 1"),
    "scored_pairs": with_(SCORED, "select * from scored"),
    "pair_quality": with_(JUDGED + f""", lab as (select round(s.p, 4) as p, s.p as p0, (t.rec_id is not null)::int as y from scored s left join truth t on t.s1_id = s.s1_id and t.rec_id = s.rec_id where {_BUCKET.format('s.s1_id')} < 5),
rk as (select *, (rank() over (order by p) + rank() over (order by p) + count(*) over (partition by p) - 1) / 2 as r from lab)""",
        "select count(*) as n, sum(y)::bigint as positives, round(sum(((p0 >= 0.5)::int = y)::int) / count(*), 6) as accuracy, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) as auc from rk"),
    "ce_pair_text": with_(RANKED, "select s1_id, rec_id, q_name_alnum || ' ; ' || q_addr_street as a, c_name_alnum || ' ; ' || c_addr_street as b from compressed"),
    "ce_train_set": with_(LINKS + "," + TRUTH + f", pick as (select * from (select *, row_number() over (partition by country order by md5('0|' || s1_id || '|' || rec_id), s1_id, rec_id) as n from capped where {_BUCKET.format('s1_id')} >= 5) where n <= 200)",
        "select p.s1_id, p.rec_id, a.name_alnum || ' ; ' || a.addr_street as a, b.name_alnum || ' ; ' || b.addr_street as b, (t.rec_id is not null)::int as label from pick p join rec a on a.entity_id = p.s1_id join rec b on b.entity_id = p.rec_id left join truth t on t.s1_id = p.s1_id and t.rec_id = p.rec_id"),
    "second_scores": with_(BLENDED, "select s1_id, rec_id, second from second"),
    "second_scores_rest": with_(BLENDED, "select s1_id, rec_id, second from second"),
    "blend_scores": with_(BLENDED, "select s1_id, rec_id, blended from blended"),
    "anchors": with_(SCORED + ", a as (select *, row_number() over (partition by country, s1_id order by p desc, rec_id) as r from scored where p >= 0.9), j as (select t.country, t.s1_id, t.rec_id, a.rec_id as anchor, a.p as ap, row_number() over (partition by t.country, t.s1_id, t.rec_id order by a.p desc, a.rec_id) as k from scored t join a on a.country = t.country and a.s1_id = t.s1_id and a.rec_id <> t.rec_id and a.r <= 4 where t.p between 0.02 and 0.98)",
        "select s1_id, rec_id, max(ap) as a_max, round(avg(ap), 6) as a_mean, count(*) as n from j where k <= 3 group by 1, 2"),
    "stage2_group_stats": with_(SCORED, "select s1_id, rec_id, p, max(p) over w as g_max, coalesce(nth_value(p, 2) over (o rows between unbounded preceding and unbounded following), 0) as g_second, round(sum(p) over w, 6) as g_sum, count(*) over w as g_size, sum((p > 0.5)::int) over w::bigint as g_strong, row_number() over o as g_rank, lag(p) over o as g_before, lead(p) over o as g_after from scored window w as (partition by country, s1_id), o as (partition by country, s1_id order by p desc, rec_id)"),
    "decide_threshold": with_(SCORED, f"select country, s1_id, rec_id, p from scored where p >= {_T}"),
    "decide_margin": with_(SCORED, f"select country, s1_id, rec_id, p from (select *, max(p) over (partition by country, s1_id) as m from scored where p >= {_T}) where p >= round(m - 0.1, 9)"),
    "decide_unique": with_(SCORED, unique_of("scored")),
    "entity_f05": with_(_COUNTS, f"select s1_id, n_true, n_pred, n_hit, round({_F}, 6) as f05 from counts"),
    "macro_f05": with_(_COUNTS, f"select round(avg({_F}), 6) as macro_f05, sum(n_hit)::bigint as tp, sum(n_pred - n_hit)::bigint as fp, sum(n_true - n_hit)::bigint as fn, round(sum(n_hit) / sum(n_pred), 6) as micro_precision, round(sum(n_hit) / sum(n_true), 6) as micro_recall, count(*) as n_entities, round(avg(case when n_true = 0 then (n_pred = 0)::int end), 6) as singleton_accuracy from counts"),
    "f05_loss": with_(_COUNTS, f"""select kind, count(*) as n_entities, round(sum(1 - f) / (select count(*) from counts), 6) as loss from (select case when n_true = 0 then 'singleton_given_matches' when n_pred = 0 then 'predicted_empty'
        when n_pred > n_hit and n_true > n_hit then 'has_fp_and_fn' when n_pred > n_hit then 'has_fp_only' else 'has_fn_only' end as kind, {_F} as f from counts) where f < 1 group by 1"""),
    "threshold_sweep": with_(JUDGED + grid_of("grid", [(x, None, False) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)]) + lists_of("a_", "scored") + swept("a_", "grid"), "select threshold, macro_f05, n_pred from a_swept"),
    "threshold_search": with_(JUDGED + grid_of("grid0", _MARGIN_GRID) + lists_of("a_", "scored") + ", b_pairs as (select * from a_pairs), b_ents as (select * from a_ents)" + swept("a_", "grid0") + """,
near as (select threshold as t from a_swept order by macro_f05 desc, threshold, margin nulls first limit 1),
span as (select greatest(0.05, t - 0.05)::double as lo, least(0.99, t + 0.05)::double as hi from near),
fine as (select round(lo + 0.005 * i, 4)::double as threshold, m.margin, false as uni from span, range(0, 40) as r(i), (select distinct margin from grid0) m where i < round((hi - lo) / 0.005)),
grid as (select * from grid0 union select * from fine)""" + swept("b_", "grid"), "select threshold, margin, macro_f05, n_pred, row_number() over (order by macro_f05 desc, threshold, margin nulls first) = 1 as chosen from b_swept"),
    "uniqueness_gate": with_(JUDGED + grid_of("grid", [(_T, None, False), (_T, None, True)]) + lists_of("a_", "scored") + swept("a_", "grid"), "select max(case when not uni then macro_f05 end) as plain_f05, max(case when uni then macro_f05 end) as unique_f05, max(case when uni then macro_f05 end) > max(case when not uni then macro_f05 end) as use_unique from a_swept"),
    "tune": with_(BLENDED + grid_of("tuned", TUNED) + lists_of("a_", "blended", "blended") + swept("a_", "tuned"), 'select threshold, uni as "unique", macro_f05, n_pred from a_swept'),
    "two_fold_gate": with_(BLENDED + _GATE + """,
every as (select 'plain' as model, * from a_swept union all select 'blend', * from b_swept),
best as (select model, 1 - fold as fold, threshold, uni from (select *, row_number() over (partition by model, fold order by macro_f05 desc, threshold, uni) as n from every) where n = 1),
got as (select e.model, e.fold, e.threshold, e.uni, e.macro_f05 from every e join best b on b.model = e.model and b.fold = e.fold and b.threshold = e.threshold and b.uni = e.uni),
gained as (select *, round(avg(macro_f05) over (partition by model) - avg(case when model = 'plain' then macro_f05 end) over (), 6) as gain from got)""", 'select model, fold::int as fold, threshold, uni as "unique", macro_f05, gain, gain > 0.0005 as kept from gained'),
    "overlay_decisions": with_(BLENDED + f", base as ({unique_of('scored')}), fresh as ({unique_of('blended', 'blended')}), ids as (select distinct s1_id from second)", "select * from base where s1_id not in (select s1_id from ids) union all select * from fresh where s1_id in (select s1_id from ids)"),
    "error_attribution": with_(JUDGED + f", matches as ({unique_of('scored')})", """select kind, count(*) as n from (
        select case when c.rec_id is null then 'fn_blocking' else 'fn_matcher' end as kind from truth t left join compressed c on c.s1_id = t.s1_id and c.rec_id = t.rec_id where not exists (select 1 from matches m where m.s1_id = t.s1_id and m.rec_id = t.rec_id)
        union all select case when o.s1_id is not null then 'fp_other_owner' when f.k_num_close > 0 then 'fp_sibling' else 'fp_unowned' end from matches m join feats f on f.s1_id = m.s1_id and f.rec_id = m.rec_id left join truth o on o.rec_id = m.rec_id where o.s1_id is null or o.s1_id <> m.s1_id) group by 1"""),
    "matching_results": with_(JUDGED + f", matches as ({unique_of('scored')})", "select u.s1_id as source1_entity_id, coalesce(string_agg(distinct m.rec_id, ',' order by m.rec_id), '') as matched_entity_ids from universe u left join matches m on m.s1_id = u.s1_id group by 1"),
}
