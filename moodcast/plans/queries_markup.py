"""Registered queries: price rows of pages with any markup (SRC-8, SRC-9, SNK-6).

The oracle reads no page: the rows follow from the events that the pages were made of.
"""

from __future__ import annotations

from moodcast.operators.upsert import latest_per_key, upsert_rows
from moodcast.plans.oracle_fixtures import EPOCH, with_fixtures
from moodcast.plans.registry import register
from moodcast.sources.markup import markup_prices, markup_prices_a, markup_prices_b

# every event is a row of its page; forms 5 and 9 have no time or value
_MADE = ("made", f"""
select *, cast(row_number() over (partition by page_id order by event_id) - 1 as int) row_idx from (
  select event_id, case when event_type in ('click', 'view') then 'nasdaq' else 'bitcoin' end name,
    case when event_type in ('click', 'view') then 'n' else 'b' end || cast(event_id // 100 as varchar) page_id,
    case when event_type in ('click', 'view') then cast(floor({EPOCH} / 86400.0) * 86400 as bigint) else {EPOCH} end "timestamp",
    1000 + cast(floor(value) as bigint) % 1000 + case when event_type in ('click', 'view') then 0.5::double else 0.25::double end "value"
  from events) x""")
_ROWS = 'select page_id, row_idx, "timestamp", name, "value" from made where event_id % 10 not in (5, 9)'


@register("q_price_markup_a", with_fixtures(f"{_ROWS} and name = 'nasdaq'", [], [_MADE]))
def q_price_markup_a(fx):
    return markup_prices_a(fx.price_archive().where("name = 'nasdaq'"))


@register("q_price_markup_b", with_fixtures(f"{_ROWS} and name = 'bitcoin'", [], [_MADE]))
def q_price_markup_b(fx):
    return markup_prices_b(fx.price_archive().where("name = 'bitcoin'"))


@register("q_upsert_markup", with_fixtures("""
select "timestamp", name, "value" from finance_indexes f
where not exists (select 1 from batch b where b."timestamp" = f."timestamp" and b.name = f.name)
union all select "timestamp", name, "value" from batch""", ["finance_indexes"], [
    _MADE, ("batch", f"""
select "timestamp", name, "value" from ({_ROWS}) r
qualify row_number() over (partition by "timestamp", name order by page_id desc, row_idx desc) = 1""")]))
def q_upsert_markup(fx):
    """Prices of all pages, the last row of a key, merged into the stored ones."""
    batch = latest_per_key(markup_prices(fx.price_archive()), ["timestamp", "name"], ["page_id", "row_idx"])
    return upsert_rows(fx.finance_indexes(), batch.select("timestamp", "name", "value"), ["timestamp", "name"])
