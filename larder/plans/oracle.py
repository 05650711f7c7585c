"""DuckDB oracle SQL for each registered query.

Each query is written independently of the Spark code: the binding views of
`bindings.py` as CTEs, then the operator's rule stated directly in SQL.
"""

from __future__ import annotations

# Binding views (same numbers as bindings.py).
PHONE = """case {k} % 4 when 0 then '07' || lpad(cast(floor({k} / 4) as bigint)::varchar, 9, '0')
  when 1 then '+9647' || lpad(cast(floor({k} / 4) as bigint)::varchar, 9, '0')
  when 2 then '009647' || lpad(cast(floor({k} / 4) as bigint)::varchar, 9, '0')
  else '7' || lpad(cast(floor({k} / 4) as bigint)::varchar, 9, '0') end"""

VIEWS = {
    "ingredients": """select p_partkey id, p_name name, p_type unit, cast(p_retailprice as decimal(12,2)) unit_price,
  case when p_size % 5 = 0 then 'direct' else 'quantity' end cost_method, cast(p_size * 3 as decimal(12,2)) direct_cost,
  p_size % 11 <> 0 is_active, p_size % 13 <> 0 is_visible_to_customer, p_size % 2 = 0 is_customer_removable,
  p_size % 17 = 0 is_core, p_size % 7 = 0 is_allergen from part""",
    "recipe_lines": """select cast(floor(p_partkey / 8) as bigint) recipe_id, p_partkey ingredient_id,
  cast(p_size / 8.0 as decimal(12,3)) quantity, p_partkey % 3 <> 0 is_customer_optional,
  case p_partkey % 4 when 0 then 'extra_cost_addon' when 1 then 'included_reduce_on_remove' else 'included_fixed' end pricing_rule,
  cast(p_size * 10 as decimal(12,2)) price_delta, p_partkey % 5 = 0 is_addon, cast(p_partkey % 8 as int) display_order
  from part""",
    "rids": "select distinct cast(floor(p_partkey / 8) as bigint) id from part",
    "recipes": """select id, id % 5 product_type_id, id size_id, 'recipe ' || id::varchar name,
  cast(1000 as decimal(12,2)) packaging_cost, cast(0 as decimal(12,2)) extra_cost,
  case when id % 7 = 0 then null else cast(id + 20000 as decimal(12,2)) end base_selling_price, id % 10 <> 9 is_active
  from rids""",
    "sizes": """select id, 'size ' || id::varchar name, case when id % 7 = 0 then 'custom' else 'fixed' end pricing_mode,
  cast(id as int) display_order, id % 17 <> 16 is_active from rids""",
    "product_types": """select cast(r_regionkey as bigint) id, r_name name, r_regionkey display_order,
  r_regionkey <> 4 is_active from region""",
    "per_order": """select l_orderkey, cast(min(l_shipdate) as date) pickup_date,
  cast(floor(min(l_partkey) / 8) as bigint) rid,
  coalesce(list(distinct l_partkey) filter (where l_returnflag <> 'A'), []) excluded_ids,
  coalesce(list(distinct l_partkey) filter (where l_returnflag <> 'N'), []) extra_ids
  from lineitem group by l_orderkey""",
    "requests": """select o_orderkey request_id, o_orderkey seq, o_orderdate created_at, rid % 5 product_type_id,
  rid size_id,
  case when o_orderkey % 97 = 0 then '  ' else 'customer ' || o_custkey::varchar end customer_name,
  case when o_orderkey % 89 = 0 then ' ' else """ + PHONE.format(k="o_custkey") + """ end customer_phone,
  pickup_date,
  case when o_orderkey % 3 = 0 then null else lpad((o_orderkey % 24)::varchar, 2, '0') || ':00:00' end pickup_time,
  null::varchar customer_notes,
  case when o_orderkey % 3 = 0 then 'address ' || o_orderkey::varchar end customer_address,
  case when o_orderkey % 50 = 8 then null else excluded_ids end excluded_ids,
  case when o_orderkey % 50 = 7 then null else extra_ids end extra_ids,
  o_orderstatus status
  from orders join per_order on o_orderkey = l_orderkey""",
    "pickups": "select l_orderkey, cast(min(l_shipdate) as date) pickup_date from lineitem group by l_orderkey",
    "ord": """select o_orderkey id, o_custkey customer_id, o_custkey % 5 product_type_id, o_orderpriority size_id,
  o_orderstatus status,
  cast(cast(o_totalprice as decimal(12,2)) * cast(0.7 as decimal(2,1)) as decimal(12,2)) subtotal_cost,
  case when o_orderkey % 10 = 0 then null else cast(o_totalprice as decimal(12,2)) end selling_price,
  case when o_orderkey % 10 = 0 then null else cast(o_totalprice as decimal(12,2))
    - cast(cast(o_totalprice as decimal(12,2)) * cast(0.7 as decimal(2,1)) as decimal(12,2)) end profit,
  o_orderkey % 10 = 0 needs_price_confirmation, null::varchar customer_notes, pickup_date,
  case when o_orderkey % 3 = 0 then null else lpad((o_orderkey % 24)::varchar, 2, '0') || ':00:00' end pickup_time,
  o_orderdate created_at
  from orders left join pickups on l_orderkey = o_orderkey""",
    "order_sizes": "select distinct o_orderpriority id, o_orderpriority name from orders",
    "customers": """select c_custkey id, c_name name, """ + PHONE.format(k="c_custkey") + """ phone from customer""",
    "line": """select l_orderkey order_id, l_partkey ingredient_id, p_name ingredient_name_snapshot,
  l_returnflag <> 'R' is_included, cast(l_quantity as decimal(12,3)) quantity_snapshot,
  case l_returnflag when 'N' then cast(p_size * 10 as decimal(12,2)) when 'R' then cast(p_size * -10 as decimal(12,2))
    else cast(0 as decimal(12,2)) end price_delta_applied,
  p_size % 7 = 0 is_allergen
  from lineitem join part on p_partkey = l_partkey""",
}

# Which views each view reads (so a query can list only what it uses).
_DEPS = {"recipes": ["rids"], "sizes": ["rids"], "requests": ["per_order"], "ord": ["pickups"]}


def with_views(*names: str) -> str:
    seen: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in seen) + "\n"


# Exact round(p / q * 100, 2) half away from zero, on decimals scaled to
# integers (p at scale 5, q at scale 2), so no binary floating point enters.
def margin_sql(p: str, q: str) -> str:
    P, Q = f"cast(round({p} * 100000) as hugeint)", f"cast(round({q} * 100) as hugeint)"
    return (f"case when {q} is null or {q} = 0 or {p} is null then null else "
            f"sign({P}) * sign({Q}) * ((abs({P}) * 20 + abs({Q})) // (2 * abs({Q}))) / 100.0 end")


PRICED_LINES = """v as (
  select r.*, s.pricing_mode, s.is_active size_is_active, rc.id recipe_id, rc.is_active recipe_is_active,
         rc.base_selling_price, rc.packaging_cost, rc.extra_cost
  from requests r left join sizes s on s.id = r.size_id
  left join recipes rc on rc.product_type_id = r.product_type_id and rc.size_id = r.size_id),
rl as (select l.*, i.name, i.unit_price, i.direct_cost, i.cost_method, i.is_allergen, i.is_customer_removable,
              i.is_active ing_active, i.is_visible_to_customer ing_visible
       from recipe_lines l join ingredients i on i.id = l.ingredient_id),
lx as materialized (select v.request_id, rl.*,
         case when rl.pricing_rule = 'extra_cost_addon'
              then rl.is_customer_optional and list_contains(v.extra_ids, rl.ingredient_id)
              else not coalesce(rl.is_customer_optional and rl.is_customer_removable
                                and list_contains(v.excluded_ids, rl.ingredient_id), false) end inc_raw
       from v join rl on rl.recipe_id = v.recipe_id),
unknown as (select distinct request_id from lx where pricing_rule = 'extra_cost_addon' and inc_raw is null),
checked as (select v.*, case
    when coalesce(trim(customer_name), '') = '' then 'blank_name'
    when coalesce(trim(customer_phone), '') = '' then 'blank_phone'
    when not coalesce(size_is_active, false) then 'size_unavailable'
    when recipe_id is null or not coalesce(recipe_is_active, false) then 'recipe_unavailable'
    when unknown.request_id is not null then 'null_selection' end reject_reason
  from v left join unknown on unknown.request_id = v.request_id),
valid as materialized (select * from checked where reject_reason is null),
pl as materialized (select lx.*, coalesce(inc_raw, false) inc,
         cast(case when not coalesce(inc_raw, false) then 0 when cost_method = 'direct' then direct_cost
                   else quantity * unit_price end as decimal(12,2)) cost,
         cast(case when pricing_rule = 'included_reduce_on_remove' and not coalesce(inc_raw, false) then -price_delta
                   when pricing_rule = 'extra_cost_addon' and coalesce(inc_raw, false) then price_delta
                   else 0 end as decimal(12,2)) delta
       from lx join (select request_id from valid) ok on ok.request_id = lx.request_id),
pa as (select request_id, sum(cost) cost_sum, sum(delta) delta_sum from pl group by request_id),
priced as (select v.request_id order_id, v.recipe_id, v.created_at, v.customer_phone, v.customer_name,
    v.customer_address, v.seq, v.pricing_mode, v.base_selling_price, v.excluded_ids, v.extra_ids,
    v.pickup_date, v.pickup_time, v.customer_notes,
    cast(coalesce(pa.cost_sum, 0) + coalesce(v.packaging_cost, 0) + coalesce(v.extra_cost, 0) as decimal(12,2)) subtotal_cost,
    cast(coalesce(pa.delta_sum, 0) as decimal(12,2)) price_adjust
  from valid v left join pa on pa.request_id = v.request_id),
priced2 as (select *, case when pricing_mode = 'custom' then null
    else cast(coalesce(base_selling_price, 0) + price_adjust as decimal(12,2)) end selling_price,
    coalesce(pricing_mode = 'custom', false) needs_price_confirmation from priced)
"""

PRICING_VIEWS = ("ingredients", "recipe_lines", "recipes", "sizes", "requests")

ORACLE: dict[str, str] = {}

ORACLE["active_catalog"] = with_views("ingredients", "recipe_lines") + """
select l.recipe_id, l.ingredient_id, i.name ingredient_name, l.display_order
from recipe_lines l left join ingredients i on i.id = l.ingredient_id where i.is_active"""

ORACLE["recipe_catalog"] = with_views("recipes", "sizes", "product_types") + """
select r.id, r.name, t.name product_type_name, s.name size_name, cast(r.base_selling_price as double) base_selling_price
from recipes r left join product_types t on t.id = r.product_type_id left join sizes s on s.id = r.size_id where r.is_active"""

MENU = """menu_lines as (
  select l.recipe_id, l.ingredient_id, l.display_order, l.is_customer_optional, i.is_customer_removable,
         l.pricing_rule, l.is_addon, i.is_allergen, l.pricing_rule <> 'extra_cost_addon' default_included
  from recipe_lines l join ingredients i on i.id = l.ingredient_id
  where i.is_active and i.is_visible_to_customer),
menu as (select r.id recipe_id, s.pricing_mode,
    case when s.pricing_mode = 'fixed' then r.base_selling_price end base_selling_price
  from recipes r join sizes s on s.id = r.size_id where r.is_active and s.is_active)
"""

ORACLE["unused_ingredients"] = with_views("ingredients", "recipe_lines") + """
select 7 recipe_id, i.id ingredient_id, i.name from ingredients i
where i.is_active and not exists (select 1 from recipe_lines l where l.recipe_id = 7 and l.ingredient_id = i.id)"""

ORACLE["recipe_menu"] = with_views("ingredients", "recipe_lines", "recipes", "sizes") + ", " + MENU + """
select m.recipe_id, m.pricing_mode, cast(m.base_selling_price as double) base_selling_price,
  count(ml.ingredient_id) n_lines,
  coalesce(string_agg(ml.ingredient_id::varchar, ',' order by ml.display_order, ml.ingredient_id), '') line_ids,
  count(ml.ingredient_id) filter (where ml.default_included) n_default_included
from menu m left join menu_lines ml on ml.recipe_id = m.recipe_id
group by m.recipe_id, m.pricing_mode, m.base_selling_price"""

ORACLE["menu_sections"] = with_views("ingredients", "recipe_lines", "recipes", "sizes") + ", " + MENU + """,
flagged as (select ml.*, coalesce(is_customer_optional and is_customer_removable
    and pricing_rule <> 'extra_cost_addon', false) is_toggleable
  from menu_lines ml where ml.recipe_id in (select recipe_id from menu))
select recipe_id, ingredient_id, is_toggleable,
  coalesce(is_customer_optional, false) and pricing_rule = 'extra_cost_addon' is_optional_addon,
  not is_toggleable and not coalesce(is_addon, false) and pricing_rule <> 'extra_cost_addon' is_fixed,
  coalesce(is_addon, false) and pricing_rule <> 'extra_cost_addon' is_fixed_addon,
  bool_or(is_toggleable and coalesce(is_allergen, false)) over (partition by recipe_id) has_allergen_warning
from flagged"""

ORACLE["scale_recipes"] = """
with base as (select p_partkey % 5 product_type_id, p_partkey ingredient_id,
                     cast(p_size / 8.0 as decimal(12,3)) quantity, p_size % 10 = 0 is_unscaled from part),
rec as (select n_nationkey recipe_id, n_regionkey product_type_id, n_nationkey % 5 size_id from nation),
sz as (select r_regionkey size_id, cast(1 + r_regionkey * 0.6 as decimal(3,1)) multiplier from region)
select rec.recipe_id, base.ingredient_id,
  cast(cast(case when base.is_unscaled then base.quantity else round(base.quantity * sz.multiplier, 2) end
       as decimal(12,3)) as double) quantity
from base join rec on rec.product_type_id = base.product_type_id join sz on sz.size_id = rec.size_id"""

ORACLE["recipe_costing"] = with_views("ingredients", "recipe_lines", "recipes", "sizes", "product_types") + """,
c as (select r.id recipe_id, r.name recipe_name, t.name product_type_name, s.name size_name, s.pricing_mode,
    coalesce(sum(case when l.pricing_rule = 'extra_cost_addon' then 0 when i.cost_method = 'direct' then i.direct_cost
                      else l.quantity * i.unit_price end), 0) + r.packaging_cost + r.extra_cost total_cost,
    r.base_selling_price
  from recipes r join product_types t on t.id = r.product_type_id join sizes s on s.id = r.size_id
  left join recipe_lines l on l.recipe_id = r.id left join ingredients i on i.id = l.ingredient_id
  group by r.id, r.name, t.name, s.name, s.pricing_mode, r.packaging_cost, r.extra_cost, r.base_selling_price)
select recipe_id, recipe_name, product_type_name, size_name, pricing_mode, cast(total_cost as double) total_cost,
  cast(base_selling_price as double) base_selling_price,
  cast(base_selling_price - total_cost as double) profit,
  """ + margin_sql("(base_selling_price - total_cost)", "base_selling_price") + """ profit_margin_pct
from c"""

_PRICING = with_views(*PRICING_VIEWS) + ", " + PRICED_LINES

ORACLE["validate_orders"] = _PRICING + "select request_id, reject_reason from checked"

ORACLE["price_orders"] = _PRICING + """
select order_id, recipe_id, cast(subtotal_cost as double) subtotal_cost, cast(price_adjust as double) price_adjust,
  cast(selling_price as double) selling_price, cast(cast(selling_price - subtotal_cost as decimal(12,2)) as double) profit,
  needs_price_confirmation
from priced2"""

ORACLE["order_lines"] = _PRICING + """
select request_id order_id, ingredient_id, name ingredient_name_snapshot, inc is_included,
  cast(quantity as double) quantity_snapshot, cast(unit_price as double) unit_price_snapshot,
  cast(cost as double) cost_snapshot, cast(delta as double) price_delta_applied, is_allergen
from pl"""

ORACLE["number_orders"] = _PRICING + """,
n as (select request_id, created_at, row_number() over (order by created_at, request_id) k from valid)
select request_id order_id, 'DLM-' || strftime(created_at, '%Y%m%d') || '-' ||
  case when k < 10000 then lpad(k::varchar, 4, '0') else k::varchar end order_number
from n"""

ORACLE["preview_mismatches"] = _PRICING + ", " + MENU.replace("menu_lines as (\n  select l.recipe_id,",
                                                              "menu_lines as (\n  select l.price_delta, l.recipe_id,") + """,
pv as (select p.order_id, p.recipe_id, p.selling_price,
    case when m.pricing_mode = 'custom' then null else cast(coalesce(m.base_selling_price, 0) + coalesce((
      select sum(case
        when ml.pricing_rule = 'included_reduce_on_remove' and not (
             case when ml.pricing_rule = 'extra_cost_addon' then coalesce(list_contains(p.extra_ids, ml.ingredient_id), false)
                  else not coalesce(ml.is_customer_optional and ml.is_customer_removable
                                    and list_contains(p.excluded_ids, ml.ingredient_id), false) end) then -ml.price_delta
        when ml.pricing_rule = 'extra_cost_addon' and coalesce(list_contains(p.extra_ids, ml.ingredient_id), false)
             then ml.price_delta
        else 0 end)
      from menu_lines ml where ml.recipe_id = p.recipe_id), 0) as decimal(12,2)) end preview_price
  from priced2 p left join menu m on m.recipe_id = p.recipe_id)
select order_id, recipe_id, cast(selling_price as double) selling_price, cast(preview_price as double) preview_price
from pv where selling_price is distinct from preview_price"""

# ---------------------------------------------------------------- lists (14-21)
FACTS = """facts as (select o.*, c.name customer_name, c.phone customer_phone, t.name type_name, s.name size_name
  from ord o left join customers c on c.id = o.customer_id
  left join product_types t on t.id = o.product_type_id left join order_sizes s on s.id = o.size_id)
"""
_FACTS = with_views("ord", "customers", "product_types", "order_sizes") + ", " + FACTS
NOTE_PATTERN = "(?i)allerg|alerg|حساس"

ORACLE["order_facts"] = _FACTS + """
select id, customer_id, customer_name, customer_phone, type_name, size_name, status,
  cast(selling_price as double) selling_price, pickup_date, created_at from facts"""

ORACLE["order_board"] = _FACTS + """
select id, created_at, status, customer_name, customer_phone, type_name, size_name,
  cast(selling_price as double) selling_price, coalesce(needs_price_confirmation, false) price_pending,
  coalesce(regexp_matches(customer_notes, 'حساس'), false) allergy_note
from facts order by created_at desc, id desc limit 200"""

ORACLE["pickups_on"] = _FACTS + """
select id, pickup_time, status, customer_name, type_name, size_name, cast(selling_price as double) selling_price
from facts where pickup_date = date '1998-06-15'"""

ORACLE["upcoming_orders"] = _FACTS + """
select id, pickup_date, pickup_time, status, customer_name, customer_phone, type_name, size_name,
  cast(selling_price as double) selling_price
from facts where pickup_date > date '1998-06-15' and status <> 'P'
order by pickup_date, pickup_time nulls last, id limit 10"""

TOTALS = """totals as (select c.id, c.name, c.phone, cast(count(o.id) as int) total_orders,
    cast(coalesce(sum(coalesce(o.selling_price, 0)), 0) as decimal(12,2)) total_spent, max(o.created_at) last_order_at
  from customers c left join ord o on o.customer_id = c.id group by c.id, c.name, c.phone)
"""

ORACLE["customer_list"] = with_views("customers", "ord") + ", " + TOTALS + """
select id, name, phone, total_orders, cast(total_spent as double) total_spent, last_order_at from totals"""

ORACLE["customer_history"] = _FACTS + """
select customer_id, id, created_at, status, cast(selling_price as double) selling_price, type_name, size_name
from facts where customer_id in (select c_custkey from customer where c_nationkey = 7)"""

ORACLE["order_detail"] = with_views("line") + """
select order_id, ingredient_id, ingredient_name_snapshot, is_included, is_allergen,
  cast(price_delta_applied as double) signed_delta, coalesce(price_delta_applied, 0) <> 0 delta_shown
from line where order_id in (select o_orderkey from orders join customer on c_custkey = o_custkey where c_nationkey = 7)"""

ORACLE["flag_allergy_notes"] = with_views("line") + """
select doc_id id, coalesce(regexp_matches(text, '""" + NOTE_PATTERN + """'), false) allergy_note,
  exists (select 1 from line where line.order_id = documents.doc_id and is_included and is_allergen) allergen_line
from documents"""

# -------------------------------------------------------------- reports (26-33)
ORACLE["ingredient_needs"] = with_views("line", "ord", "ingredients") + """
select l.ingredient_id, l.ingredient_name_snapshot ingredient_name, i.unit,
  cast(sum(l.quantity_snapshot) as double) total_quantity
from line l join ord o on o.id = l.order_id join ingredients i on i.id = l.ingredient_id
where l.is_included and o.status <> 'P' and o.pickup_date between date '1998-06-15' and date '1998-06-22'
group by l.ingredient_id, l.ingredient_name_snapshot, i.unit"""

STATS = """stats as (select l.ingredient_name_snapshot ingredient_name,
    count(*) filter (where l.is_included) included_count, count(*) filter (where not l.is_included) excluded_count
  from line l join ord o on o.id = l.order_id
  where cast(o.created_at as date) between date '1996-01-01' and date '1998-06-15'
  group by l.ingredient_name_snapshot)
"""
_STATS = with_views("line", "ord") + ", " + STATS

ORACLE["selection_stats"] = _STATS + "select * from stats"
ORACLE["top_selected"] = _STATS + """
select ingredient_name, included_count "count" from stats where included_count > 0
order by included_count desc, ingredient_name limit 8"""
ORACLE["top_excluded"] = _STATS + """
select ingredient_name, excluded_count "count" from stats where excluded_count > 0
order by excluded_count desc, included_count desc, ingredient_name limit 8"""


def _sales(cond: str, suffix: str = "") -> str:
    return (f"count(*) filter (where {cond}) orders{suffix}, "
            f"cast(coalesce(sum(coalesce(selling_price, 0)) filter (where {cond}), 0) as double) sales{suffix}, "
            f"cast(coalesce(sum(coalesce(profit, 0)) filter (where {cond}), 0) as double) profit{suffix}")


ORACLE["sales_between"] = with_views("ord") + """
select count(*) order_count, cast(coalesce(sum(coalesce(selling_price, 0)), 0) as double) sales,
  cast(coalesce(sum(coalesce(profit, 0)), 0) as double) profit
from ord where status is distinct from 'P'"""

ORACLE["trailing_sales"] = with_views("ord") + "select " + ", ".join(
    _sales(f"cast(created_at as date) between date '1998-06-15' - interval {k - 1} day and date '1998-06-15'",
           f"_{k}d") for k in (1, 7, 30)) + " from ord where status is distinct from 'P'"

ORACLE["day_kpis"] = with_views("ord") + """
select count(*) filter (where cast(created_at as date) = date '1998-06-15') orders_created,
  count(*) filter (where pickup_date = date '1998-06-15') pickups,
  cast(coalesce(sum(coalesce(selling_price, 0)) filter (where cast(created_at as date) = date '1998-06-15'
       and status is distinct from 'P'), 0) as double) sales,
  cast(coalesce(sum(coalesce(subtotal_cost, 0)) filter (where cast(created_at as date) = date '1998-06-15'
       and status is distinct from 'P'), 0) as double) cost,
  cast(coalesce(sum(coalesce(profit, 0)) filter (where cast(created_at as date) = date '1998-06-15'
       and status is distinct from 'P'), 0) as double) profit
from ord"""

ORACLE["sales_ranking"] = with_views("ord", "product_types", "order_sizes") + """,
live as (select coalesce(nullif(t.name, ''), '—') type_name, coalesce(nullif(s.name, ''), '—') size_name
  from ord o left join product_types t on t.id = o.product_type_id left join order_sizes s on s.id = o.size_id
  where cast(o.created_at as date) between date '1996-01-01' and date '1998-06-15'
    and o.status is distinct from 'P')
select 'type' dimension, type_name name, count(*) order_count from live group by type_name
union all select 'size', size_name, count(*) from live group by size_name
union all select 'total', null, count(*) from live"""

# ------------------------------------------------------------ customers (22-25)
ORACLE["upsert_customers"] = """
with ex as (select c_custkey id, c_name name, c_custkey::varchar phone,
    case when c_custkey % 2 = 0 then 'addr ' || c_nationkey::varchar end address, c_nationkey total_orders,
    cast(c_acctbal as decimal(12,2)) total_spent from customer),
inc as (select (user_id + case when user_id % 3 = 0 then 10000000 else 0 end)::varchar phone, ts, trim(event_type) name,
    case when event_id % 3 = 0 then props end address, event_id seq from events),
latest as (select phone, first(name order by seq desc) name,
    first(address order by seq desc) filter (where address is not null) address, min(ts) first_seen
  from inc group by phone)
select coalesce(ex.phone, latest.phone) phone, coalesce(latest.name, ex.name) name,
  coalesce(latest.address, ex.address) address, case when ex.id is null then first_seen end created_at,
  case when ex.id is null then 0 else total_orders end total_orders,
  cast(case when ex.id is null then 0 else total_spent end as double) total_spent, ex.id is null is_new
from ex full outer join latest on ex.phone = latest.phone"""

ORACLE["customer_totals"] = with_views("customers", "ord") + ", " + TOTALS + """
select id, total_orders, cast(total_spent as double) total_spent, last_order_at from totals"""

# The ledger checked against a plain sequential fold (recursive CTE per customer).
ORACLE["customer_ledger"] = """
with recursive ev as (select o_custkey customer_id, o_orderstatus = 'P' is_del,
    coalesce(case when o_orderkey % 10 = 0 then null else cast(o_totalprice as decimal(12,2)) end, 0) amount,
    o_orderdate ts, row_number() over (partition by o_custkey order by o_orderkey) rn from orders),
fold as (
  select customer_id, rn,
    cast(case when is_del then greatest(0, -amount) else amount end as decimal(18,2)) total,
    case when is_del then 0 else 1 end cnt, case when is_del then null else ts end last_ts
  from ev where rn = 1
  union all
  select e.customer_id, e.rn,
    cast(case when e.is_del then greatest(0, f.total - e.amount) else f.total + e.amount end as decimal(18,2)),
    case when e.is_del then greatest(0, f.cnt - 1) else f.cnt + 1 end,
    case when e.is_del then f.last_ts else e.ts end
  from fold f join ev e on e.customer_id = f.customer_id and e.rn = f.rn + 1)
select f.customer_id, cast(f.cnt as int) total_orders, cast(f.total as double) total_spent, f.last_ts last_order_at
from fold f join (select customer_id, max(rn) rn from ev group by customer_id) m
  on m.customer_id = f.customer_id and m.rn = f.rn"""

STD_PHONE = """case when d like '+%' then d when d like '00%' then '+' || substr(d, 3)
  when d like '0%' then '+964' || substr(d, 2) else '+964' || d end"""

ORACLE["phone_duplicates"] = with_views("customers") + """,
own as (select id, case when id % 5 = 0 then '+1' || lpad(id::varchar, 10, '0') else phone end phone from customers),
s1 as (select id, phone, regexp_replace(phone, '[\\s-]', '', 'g') d from own),
s2 as (select id, phone, """ + STD_PHONE + """ phone_std from s1),
s3 as (select *, count(*) over (partition by phone_std) n_customers from s2)
select phone_std, id, phone, n_customers from s3 where n_customers > 1"""

ORACLE["integrity_audit"] = with_views("recipes", "sizes") + """
select 'orders.unique_id' rule, coalesce(sum(n - 1), 0)::bigint violations
  from (select count(*) n from orders where o_orderkey is not null group by o_orderkey having count(*) > 1)
union all select 'part.unique_id', coalesce(sum(n - 1), 0)::bigint
  from (select count(*) n from part where p_partkey is not null group by p_partkey having count(*) > 1)
union all select 'lineitem.unique_order_part', coalesce(sum(n - 1), 0)::bigint
  from (select count(*) n from lineitem where l_orderkey is not null and l_partkey is not null
        group by l_orderkey, l_partkey having count(*) > 1)
union all select 'lineitem.unique_order_line', coalesce(sum(n - 1), 0)::bigint
  from (select count(*) n from lineitem where l_orderkey is not null and l_linenumber is not null
        group by l_orderkey, l_linenumber having count(*) > 1)
union all select 'lineitem.fk_order', count(*) from lineitem l
  where l_orderkey is not null and not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey)
union all select 'lineitem.fk_part', count(*) from lineitem l
  where l_partkey is not null and not exists (select 1 from part p where p.p_partkey = l.l_partkey)
union all select 'orders.fk_customer', count(*) from orders o
  where o_custkey is not null and not exists (select 1 from customer c where c.c_custkey = o.o_custkey)
union all select 'orders.created_not_null', count(*) filter (where o_orderdate is null) from orders
union all select 'orders.status_allowed', count(*) filter (where o_orderstatus not in ('F', 'O', 'P')) from orders
union all select 'lineitem.flag_allowed', count(*) filter (where l_returnflag not in ('A', 'N', 'R')) from lineitem
union all select 'recipes.price_null_only_custom', count(*) from recipes r left join sizes s on s.id = r.size_id
  where r.base_selling_price is null and not coalesce(s.pricing_mode = 'custom', false)"""

# -------------------------------------------------------------- changes (34-35)
ORACLE["apply_changes"] = """
with ch as (select user_id, event_id seq, ts changed_at,
    case event_type when 'error' then 'delete' when 'signup' then 'insert' else 'update' end op,
    event_type name, true name_set, value, event_type in ('purchase', 'click') value_set,
    case when event_id % 6 = 0 then null else props end props, event_id % 3 = 0 props_set from events),
r as (select user_id, max(seq) reset_seq, first(op order by seq desc) reset_op
      from ch where op in ('insert', 'delete') group by user_id),
eff as (select ch.* from ch left join r using (user_id) where r.reset_seq is null or ch.seq >= r.reset_seq),
lv as (select user_id,
    first(name order by seq desc) filter (where name_set) name_v, bool_or(name_set) name_g,
    first(value order by seq desc) filter (where value_set) value_v, bool_or(value_set) value_g,
    first(props order by seq desc) filter (where props_set) props_v, bool_or(props_set) props_g,
    first(changed_at order by seq desc) last_ts
  from eff group by user_id),
base as (select c_custkey user_id, c_name name, c_acctbal value, null::varchar props, null::timestamp updated_at
         from customer),
j as (select coalesce(b.user_id, lv.user_id) user_id, b.user_id in_base, b.name, b.value, b.props, b.updated_at,
         lv.*, r.reset_op
      from base b full outer join lv on b.user_id = lv.user_id
      left join r on r.user_id = coalesce(b.user_id, lv.user_id))
select user_id,
  case when coalesce(name_g, false) then name_v when reset_op = 'insert' then null else name end name,
  case when coalesce(value_g, false) then value_v when reset_op = 'insert' then null else value end value,
  case when coalesce(props_g, false) then props_v when reset_op = 'insert' then null else props end props,
  case when last_ts is not null then last_ts else updated_at end updated_at
from j
where case when reset_op = 'delete' then false when reset_op = 'insert' then true else in_base is not null end"""

ORACLE["new_line_defaults"] = with_views("recipe_lines") + """,
added as (select cast(floor(p_partkey / 8) as bigint) + 1 recipe_id, p_partkey ingredient_id, p_size from part)
select a.recipe_id, a.ingredient_id, false is_customer_optional, 'included_fixed' pricing_rule,
  cast(case when p_size % 4 = 0 then p_size else 0 end as double) price_delta, false is_addon,
  cast((select count(*) from recipe_lines l where l.recipe_id = a.recipe_id)
    + row_number() over (partition by a.recipe_id order by a.ingredient_id) as int) display_order
from added a"""

ORACLE["cascade_delete"] = """
select l_orderkey, l_linenumber, l_partkey from lineitem l
where not exists (select 1 from orders o where o.o_orderstatus = 'P' and o.o_orderkey = l.l_orderkey)"""

ORACLE["restrict_check"] = with_views("ingredients") + """
select l_partkey, count(*) blocking_rows from lineitem
where l_partkey in (select id from ingredients where not is_active) group by l_partkey"""

# ------------------------------------------------------------- streams (36-39)
# The streaming forms must give the batch operators' results.
ORACLE["stream_price_orders"] = ORACLE["price_orders"]
ORACLE["stream_ingredient_needs"] = ORACLE["ingredient_needs"]
ORACLE["stream_customer_ledger"] = ORACLE["customer_ledger"]

ORACLE["stream_daily_sales"] = with_views("ord") + """,
live as (select cast(created_at as date) created_date, selling_price, profit
         from ord where status is distinct from 'P'),
days as (select created_date, count(*) order_count, cast(sum(coalesce(selling_price, 0)) as double) sales,
           cast(sum(coalesce(profit, 0)) as double) profit from live group by created_date)
select * from days"""

# --------------------------------------------------- placing a batch of orders
_PLACED = with_views(*PRICING_VIEWS, "customers") + ", " + PRICED_LINES + """,
n as (select *, row_number() over (order by created_at, order_id) k from priced2),
inc as (select trim(customer_phone) phone, trim(customer_name) name, customer_address address, seq, created_at,
          selling_price from priced2),
latest as (select phone, first(name order by seq desc) name,
    first(address order by seq desc) filter (where address is not null) address,
    count(*) n, sum(coalesce(selling_price, 0)) s, max(created_at) last from inc group by phone)
"""

# Each placed order's note is the whole text of the document of its number.
_PLACED = _PLACED.replace("null::varchar customer_notes",
                          "(select d.text from documents d where d.doc_id = o_orderkey) customer_notes")

ORACLE["create_orders"] = _PLACED + """
select n.order_id, 'DLM-' || strftime(n.created_at, '%Y%m%d') || '-' ||
    case when k < 10000 then lpad(k::varchar, 4, '0') else k::varchar end order_number,
  c.id customer_id, 'جديد' status, cast(subtotal_cost as double) subtotal_cost,
  cast(selling_price as double) selling_price, cast(cast(selling_price - subtotal_cost as decimal(12,2)) as double) profit,
  needs_price_confirmation, coalesce(customer_notes, '') customer_notes, pickup_date, pickup_time
from n left join customers c on c.phone = trim(n.customer_phone)"""

ORACLE["create_orders_customers"] = _PLACED + """
select c.id, coalesce(l.name, c.name) name, coalesce(c.phone, l.phone) phone, l.address address,
  cast(coalesce(l.n, 0) as int) total_orders, cast(cast(coalesce(l.s, 0) as decimal(12,2)) as double) total_spent,
  l.last last_order_at
from customers c full outer join latest l on l.phone = c.phone"""

_NUMBER = """'DLM-' || strftime(n.created_at, '%Y%m%d') || '-' ||
    case when k < 10000 then lpad(k::varchar, 4, '0') else k::varchar end"""

ORACLE["order_confirmation"] = _PLACED + """
select n.order_id, """ + _NUMBER + """ order_number, cast(selling_price as double) selling_price,
  needs_price_confirmation, pickup_date, pickup_time, pl.name ingredient_name, pl.inc is_included
from n left join pl on pl.request_id = n.order_id"""

ORACLE["stored_orders"] = _PLACED + """
select n.order_id id, """ + _NUMBER + """ order_number, c.id customer_id, n.recipe_id % 5 product_type_id,
  n.recipe_id size_id, n.recipe_id, 'جديد' status, cast(subtotal_cost as double) subtotal_cost,
  cast(selling_price as double) selling_price, cast(cast(selling_price - subtotal_cost as decimal(12,2)) as double) profit,
  needs_price_confirmation, coalesce(customer_notes, '') customer_notes, null::varchar admin_notes, pickup_date, pickup_time,
  n.created_at, n.created_at updated_at
from n left join customers c on c.phone = trim(n.customer_phone)"""

ORACLE["stream_create_orders"] = ORACLE["stored_orders"]

# The data model's rules: not null, unique, references, allowed values.
_RULE_COLUMNS = {
    "product_types": "id name display_order is_active",
    "sizes": "id name pricing_mode display_order is_active",
    "ingredients": "id name unit unit_price cost_method direct_cost is_active is_visible_to_customer "
                   "is_customer_removable is_core is_allergen",
    "recipes": "id product_type_id size_id name packaging_cost extra_cost is_active",
    "recipe_lines": "recipe_id ingredient_id quantity is_customer_optional pricing_rule price_delta is_addon display_order",
    "customers": "id name phone total_orders total_spent",
    "ord": "id customer_id product_type_id size_id status subtotal_cost needs_price_confirmation created_at",
    "line": "order_id ingredient_id ingredient_name_snapshot is_included quantity_snapshot price_delta_applied is_allergen",
}
_SHOWN = {"ord": "orders", "line": "order_lines", "customers": "customers"}
_READ = {"customers": "kitchen_customers"}
_UNIQUE = [*((t, "id") for t in ("product_types", "sizes", "ingredients", "recipes", "customers", "ord")),
           ("recipes", "product_type_id, size_id"), ("recipe_lines", "recipe_id, ingredient_id"), ("customers", "phone")]
_REFERENCES = [("recipes", "product_type_id", "product_types"), ("recipes", "size_id", "sizes"),
               ("recipe_lines", "recipe_id", "recipes"), ("recipe_lines", "ingredient_id", "ingredients"),
               ("ord", "customer_id", "customers"), ("ord", "product_type_id", "product_types"), ("ord", "size_id", "sizes"),
               ("line", "order_id", "ord"), ("line", "ingredient_id", "ingredients")]
_ALLOWED = [("sizes", "pricing_mode", "'fixed', 'custom'"), ("ingredients", "cost_method", "'quantity', 'direct'"),
            ("recipe_lines", "pricing_rule", "'included_fixed', 'included_reduce_on_remove', 'extra_cost_addon'"),
            ("ord", "status", "'جديد', 'تم التأكيد', 'قيد التحضير', 'جاهز', 'تم التسليم', 'ملغي'")]


def _audit_sql() -> str:
    def shown(t: str) -> str:
        return _SHOWN.get(t, t)

    def read(t: str) -> str:
        return _READ.get(t, t)

    parts = [f"select '{shown(t)}.{c} not null' rule, count(*)::bigint violations from {read(t)} where {c} is null"
             for t, cols in _RULE_COLUMNS.items() for c in cols.split()]
    for t, cols in _UNIQUE:
        known = " and ".join(f"{c} is not null" for c in cols.split(", "))
        parts.append(f"select '{shown(t)}.{cols} unique', (count(*) - count(distinct ({cols})))::bigint "
                     f"from {read(t)} where {known}")
    for t, c, to in _REFERENCES:
        parts.append(f"select '{shown(t)}.{c} references {shown(to)}', count(*)::bigint from {read(t)} x where {c} is not null "
                     f"and not exists (select 1 from {read(to)} p where p.id::varchar = x.{c}::varchar)")
    for t, c, values in _ALLOWED:
        parts.append(f"select '{shown(t)}.{c} allowed', count(*)::bigint from {read(t)} where {c} not in ({values})")
    parts.append("select 'recipes.base_selling_price null only for custom sizes', count(*)::bigint from recipes r "
                 "left join sizes s on s.id = r.size_id where r.base_selling_price is null "
                 "and not coalesce(s.pricing_mode = 'custom', false)")
    return "\nunion all ".join(parts)


ORACLE["kitchen_audit"] = with_views("customers", "ingredients", "recipe_lines", "recipes", "sizes", "product_types", "ord",
                                     "line") + """,
s1 as (select id, name, regexp_replace(phone, '[\\s-]', '', 'g') d from customers),
kitchen_customers as (select id, name, """ + STD_PHONE + """ phone, 0 total_orders, 0 total_spent from s1)
""" + _audit_sql()


# Deletes through the key graph: orders and recipes first (their lines go with them), then what only they referred to.
_DELETES = with_views("customers", "ord", "line", "ingredients", "recipe_lines", "recipes", "sizes", "product_types") + """,
gone_orders as (select id from ord where status = 'P'),
gone_recipes as (select id from recipes where id % 3 = 0),
left_orders as (select * from ord where id not in (select id from gone_orders)),
left_recipes as (select * from recipes where id not in (select id from gone_recipes)),
left_lines as (select * from line where order_id not in (select id from gone_orders)),
left_recipe_lines as (select * from recipe_lines where recipe_id not in (select id from gone_recipes)),
blocks as (
  select 'customers' table_name, customer_id id, count(*) n from left_orders group by 2
  union all select 'sizes', size_id, count(*) from left_recipes group by 2
  union all select 'product_types', id, sum(n) from (select product_type_id id, count(*) n from left_orders group by 1
    union all select product_type_id, count(*) from left_recipes group by 1) group by 2
  union all select 'ingredients', id, sum(n) from (select ingredient_id id, count(*) n from left_lines group by 1
    union all select ingredient_id, count(*) from left_recipe_lines group by 1) group by 2),
asked as (
  select 'customers' table_name, id from customers where id % 5 = 0 union all select 'sizes', id from sizes where id % 2 = 0
  union all select 'product_types', id from product_types union all select 'ingredients', id from ingredients where not is_active),
told as (
  select 'orders' table_name, g.id, 'deleted' outcome, (select count(*) from line l where l.order_id = g.id) n_cascaded, 0 n_blocking
  from gone_orders g
  union all select 'recipes', g.id, 'deleted', (select count(*) from recipe_lines l where l.recipe_id = g.id), 0 from gone_recipes g
  union all select a.table_name, a.id, case when coalesce(n, 0) > 0 then 'blocked' else 'deleted' end, 0, coalesce(n, 0)
  from asked a left join blocks b on a.table_name = b.table_name and a.id = b.id
  union all select 'customers', -id - 1, 'missing', 0, 0 from customers where id % 50 = 0)
"""
ORACLE["delete_closure"] = _DELETES + """
select table_name, id::varchar id, outcome, n_cascaded::bigint n_cascaded, n_blocking::bigint n_blocking from told"""
ORACLE["delete_closure_left"] = _DELETES + """,
kept as (select id from customers where id not in (select id from told where table_name = 'customers' and outcome = 'deleted'))
select 'orders' table_name, (select count(*) from left_orders) n_left, null::double total_spent
union all select 'order_lines', (select count(*) from left_lines), null
union all select 'recipes', (select count(*) from left_recipes), null
union all select 'recipe_lines', (select count(*) from left_recipe_lines), null
union all select 'customers', count(*), (select cast(sum(coalesce(selling_price, 0)) as double) from left_orders
  where customer_id in (select id from kept)) from kept
union all select s.t, s.n - (select count(*) from told where table_name = s.t and outcome = 'deleted'), null from (
  select 'sizes' t, count(*) n from sizes union all select 'product_types', count(*) from product_types
  union all select 'ingredients', count(*) from ingredients) s"""

ORACLE["edited_numbers"] = """
with v as (select p_partkey, p_partkey % 16 kind, case p_partkey % 16
    when 2 then p_size when 3 then (p_size * 1000 + p_partkey % 1000) / 1000.0 when 4 then p_size * 100 when 5 then 0.5 when 6 then p_size
    when 7 then p_partkey when 8 then 5 when 9 then 15 when 13 then -p_size * 10 else 0 end::double x from part)
select p_partkey, case when kind not in (10, 11, 14) then x end "value", kind in (10, 11, 14) is_infinite,
  case when kind = 3 then cast(cast(cast(x as decimal(18,3)) as decimal(12,2)) as double) when kind not in (10, 11, 14) then x end money
from v"""

ORACLE["form_checks"] = _PRICING + """
select request_id, case when reject_reason in ('blank_name', 'blank_phone') then reject_reason
  when pickup_date is null or coalesce(pickup_time, '') = '' then 'pickup_missing' else reject_reason end reject_reason
from checked"""

ORACLE["selection_arrays"] = with_views("ingredients", "recipe_lines", "recipes", "sizes") + ", " + MENU.replace(
    "menu_lines as (\n  select l.recipe_id,", "menu_lines as (\n  select l.price_delta, l.recipe_id,") + """,
bought as (select l_orderkey k, l_partkey id, max(l_returnflag) = 'R' "on" from lineitem group by 1, 2),
req as (select k, cast(floor(min(id) / 8) as bigint) recipe_id from bought group by k),
own as (select k, recipe_id * 8 + (k + n) % 8 id, case when k % 6 <> n then k % 2 = n % 2 end "on"
        from req, (values (0), (3)) x(n)),
ticks as (select * from own union all select * from bought b where not exists (select 1 from own o where o.k = b.k and o.id = b.id)),
sel as (select r.k, ml.*, coalesce(ml.is_customer_optional and ml.is_customer_removable and ml.pricing_rule <> 'extra_cost_addon', false) free,
    case when t.id is not null and r.k % 11 <> 0 then coalesce(t."on", false) else ml.default_included end chosen
  from req r join menu using (recipe_id) join menu_lines ml using (recipe_id) left join ticks t on t.k = r.k and t.id = ml.ingredient_id),
arr as (select k, string_agg(ingredient_id::varchar, ',' order by display_order, ingredient_id) filter (free and not chosen) excluded_ids,
    string_agg(ingredient_id::varchar, ',' order by display_order, ingredient_id) filter (pricing_rule = 'extra_cost_addon' and chosen) extra_ids,
    sum(case when pricing_rule = 'included_reduce_on_remove' and free and not chosen then -price_delta
             when pricing_rule = 'extra_cost_addon' and chosen then price_delta else 0 end) adjust
  from sel group by k)
select r.k request_id, case when m.recipe_id is not null then coalesce(excluded_ids, '') end excluded_ids,
  case when m.recipe_id is not null then coalesce(extra_ids, '') end extra_ids,
  case when m.recipe_id is not null and m.pricing_mode <> 'custom'
       then cast(cast(coalesce(m.base_selling_price, 0) + coalesce(adjust, 0) as decimal(12,2)) as double) end preview_price
from req r left join menu m using (recipe_id) left join arr using (k)"""

ORACLE["daily_rollup"] = with_views("ord") + """
select cast(created_at as date) created_date, product_type_id, size_id, status, count(*) order_count,
  cast(sum(coalesce(selling_price, 0)) as double) sales, cast(sum(coalesce(profit, 0)) as double) profit
from ord group by 1, 2, 3, 4"""
ORACLE["rollup_trailing"] = ORACLE["trailing_sales"]
ORACLE["rollup_ranking"] = ORACLE["sales_ranking"]
