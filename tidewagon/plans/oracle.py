"""The same queries as plain SQL, for a value check by another engine.

Written from the definitions and not from the Spark plans: ordered counters are one window per
customer, latest rows a ``row_number``, windows a list of starts.
"""

from __future__ import annotations

import re

_EVENT_SITE = ("case user_id % 5 when 0 then 'WH-RTM' when 1 then 'WH-FRA' when 2 then 'WH-BCN' "
               "when 3 then 'WH-WAW' else 'WH-STO' end")


def _latest(source: str, key: str, fields: str, condition: str = "true") -> str:
    return f"""select {key}, {fields} from (
        select *, row_number() over (partition by {key} order by timestamp desc, seq desc) as rn
        from {source} where {condition}) where rn = 1"""


def _pick(index: str, values: tuple) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[cast({index} as int) + 1]"


_SITES = ("WH-RTM", "WH-FRA", "WH-BCN", "WH-WAW", "WH-STO")
_OPS = ("RECEIVING", "PUTAWAY", "PICK", "PACK", "LOAD", "INVENTORY_ADJUSTMENT", "CYCLE_COUNT")
_OPEN_SHIPMENT = "event_type not in ('DELIVERED', 'CANCELLED')"
_LATE = f"{_OPEN_SHIPMENT} and expected_delivery <> 0 and timestamp > expected_delivery + 1800000"
_OPEN_ORDER = "status not in ('DELIVERED', 'CANCELLED', 'RETURNED', 'PARTIAL_FAILURE')"
_MINUTES = "(sla_timestamp - timestamp) // 60000"
_TRACKED = f"{_OPEN_ORDER} and {_MINUTES} <= 60"


def _site(key: str) -> str:
    return f"case when {key} < 5 then {_pick(key, _SITES)} else printf('WH-%04d', {key}) end"


_REF_VEHICLES = f"""select printf('VEH-%03d', s_suppkey + 1) as vehicle_id, {_pick('s_nationkey % 3', ('VAN', 'BOX_TRUCK', 'SEMI_TRAILER'))} as vehicle_type,
    upper(substr(s_name, 1, 3)) || '-' || s_nationkey || '-' || s_suppkey as license_plate,
    (1500 + s_nationkey * 500)::double as capacity_kg, (10 + s_nationkey * 2)::double as capacity_cubic_m,
    case when s_acctbal < -500 then null when s_acctbal > 9500 then 'WH-N' || s_nationkey else {_site('s_suppkey')} end as home_warehouse_id,
    case when s_acctbal < 0 then 'MAINTENANCE' when s_acctbal < 4000 then 'AVAILABLE' when s_acctbal < 9000 then 'IN_USE' else 'RETIRED' end as status,
    case s_nationkey % 5 when 0 then 'ELECTRIC' when 1 then 'HYBRID' else 'DIESEL' end as fuel_type from supplier"""
_REF_DRIVERS = f"""select printf('DRV-%03d', c_custkey + 1) as driver_id, lower(c_mktsegment) as first_name, c_name as last_name,
    {_pick('c_nationkey % 3', ('B', 'C', 'CE'))} as license_type, {_pick('c_nationkey % 4', ('ADR', 'HACCP', 'ADR,HACCP', ''))} as certifications,
    case when c_acctbal > 5000 then printf('VEH-%03d', c_custkey // 15 + 1) end as assigned_vehicle_id,
    case when c_acctbal < -500 then null when c_acctbal > 9500 then 'WH-N' || c_nationkey else {_site('c_custkey // 15')} end as home_warehouse_id,
    case when c_mktsegment = 'BUILDING' then 'VACATION' when c_acctbal < 0 then 'OFF_DUTY'
      when c_mktsegment = 'MACHINERY' then 'ON_DUTY' else 'AVAILABLE' end as status from customer"""
_REF_ROUTES = f"""select printf('RTE-%03d', p_partkey + 1) as route_id,
    case when p_size >= 50 then 'WH-P' || p_size else {_site('p_partkey // 20')} end as origin_warehouse_id,
    n_name as destination_city, r_name as destination_country, round(p_retailprice, 2) as distance_km,
    p_size / 4.0::double as estimated_hours, {_pick('p_size % 3', ('DIRECT', 'HUB_SPOKE', 'MULTI_STOP'))} as route_type,
    p_size < 45 as active from part join nation on p_size % 25 = n_nationkey join region on n_regionkey = r_regionkey"""


_MAIN_SITES = """select * from (values
    (0, 'WH-RTM', 'Rotterdam Distribution Center', 'Rotterdam', 'Netherlands', 51.9225::double, 4.47917::double),
    (1, 'WH-FRA', 'Frankfurt Logistics Hub', 'Frankfurt', 'Germany', 50.1109, 8.68213),
    (2, 'WH-BCN', 'Barcelona Fulfillment Center', 'Barcelona', 'Spain', 41.3874, 2.16996),
    (3, 'WH-WAW', 'Warsaw Regional Depot', 'Warsaw', 'Poland', 52.2297, 21.0122),
    (4, 'WH-STO', 'Stockholm Nordic Hub', 'Stockholm', 'Sweden', 59.3293, 18.0686))
    as t(pos, warehouse_id, name, city, country, latitude, longitude)"""

_BY_CUSTOMER = "partition by customer_id order by timestamp, seq rows between unbounded preceding and current row"


def _clamp(step: str) -> str:
    """Running value of a counter floored at 0, from its column of steps."""
    return f"{step}_run - least(0, min({step}_run) over w)"


# Named parts; each SELECT below may use any of them, and brings in what it mentions.
_PARTS = {
    "ev": """select event_id as seq, epoch_us(ts) // 1000 as ts_ms, user_id, event_type, value,
        cast(json_extract_string(props, '$.k') as int) as k from events""",
    "ship": f"""select seq, concat('SH-', user_id, '-', seq % 7) as shipment_id, {_EVENT_SITE} as warehouse_id,
        printf('CUST-%04d', user_id) as customer_id, ts_ms + ((seq * 37) % 121 - 60) * 60000 as expected_delivery,
        {_pick('user_id % 4', ('Berlin', 'Paris', 'Madrid', 'Oslo'))} as destination_city,
        {_pick('user_id % 4', ('Germany', 'France', 'Spain', 'Norway'))} as destination_country,
        case event_type when 'signup' then 'CREATED' when 'purchase' then 'DELIVERED' when 'view' then 'IN_TRANSIT'
          when 'error' then case when seq % 4 = 0 then 'CANCELLED' else 'EXCEPTION' end
          else {_pick('seq % 4', ('PICKED', 'PACKED', 'DISPATCHED', 'OUT_FOR_DELIVERY'))} end as event_type,
        ts_ms as timestamp from ev""",
    "ords": f"""select seq, printf('ORD-%05d', user_id * 5 + seq % 5) as order_id, printf('CUST-%04d', user_id) as customer_id,
        ts_ms as timestamp,
        {_pick('seq * 31 % 8', ('RECEIVED', 'VALIDATED', 'ALLOCATED', 'SHIPPED', 'DELIVERED', 'CANCELLED', 'RETURNED', 'PARTIAL_FAILURE'))} as status,
        case when seq % 2 = 0 then [concat('SH-', user_id, '-', seq % 5), concat('SH-', user_id, '-', seq % 5 + 2)]
          else [concat('SH-', user_id, '-', seq % 5)] end as shipment_ids,
        1 + k % 10 as total_items, ts_ms + ((seq * 53) % 181 - 60) * 60000 as sla_timestamp,
        case when seq % 20 < 12 then 'STANDARD' when seq % 20 < 17 then 'EXPRESS' when seq % 20 < 19 then 'SAME_DAY' else 'CRITICAL' end as priority
        from ev""",
    "tel": """select seq, printf('VEH-%03d', user_id % 50 + 1) as vehicle_id, ts_ms as timestamp,
        45.0::double + value / 50 as latitude, 5.0::double + value / 100 as longitude,
        case when event_type = 'view' then 40.0::double + value / 10 else 0.0::double end as speed_kmh, cast(seq % 360 as double) as heading,
        case event_type when 'view' then 'EN_ROUTE' when 'click' then 'IDLE' when 'signup' then 'LOADING'
          when 'purchase' then 'UNLOADING' else 'MAINTENANCE' end as status,
        k % 20 as shipment_count, value * 3 as weight_kg, value / 100 as volume_cubic_m,
        printf('DRV-%03d', user_id % 75 + 1) as driver_id, 100 - value / 5 as fuel_level_percent, 10000.0::double + seq as odometer_km
        from ev""",
    "ops": f"""select seq, {_EVENT_SITE} as warehouse_id, ts_ms as timestamp, {_pick('seq % 7', _OPS)} as operation_type,
        k as quantity, case when seq % 7 in (2, 3, 4) then concat('SH-', user_id, '-', seq % 5) end as shipment_id,
        10 + k * 3 as duration_seconds, event_type = 'error' as has_error from ev""",
    "customers": f"""select printf('CUST-%04d', c_custkey) as customer_id, c_name as company_name,
        concat(lower(c_mktsegment), c_custkey, '@example.com') as contact_email,
        {_pick('c_nationkey % 4', ('STANDARD', 'EXPRESS', 'SAME_DAY', 'CRITICAL'))} as sla_tier,
        case when c_acctbal < 0 then 'SUSPENDED' else 'ACTIVE' end as account_status, c_acctbal from customer""",
    "products": """select printf('PROD-%06d', p_partkey) as product_id, printf('SKU-%08d', p_partkey) as sku, p_name as name,
        upper(p_type) as category, round(p_size / 10.0::double, 6) as weight_kg, null::double as length_cm,
        null::double as width_cm, null::double as height_cm, round(p_retailprice, 6) as unit_price from part""",
    "warehouses": f"""select warehouse_id, name, city, country, latitude, longitude, 'OPERATIONAL' as status
          from ({_MAIN_SITES}) join supplier on s_suppkey = pos
        union all select printf('WH-%04d', s_suppkey), s_name, n_name, r_name, (40 + s_nationkey)::double, s_nationkey::double,
          case when s_acctbal < 0 then 'CLOSED' else 'OPERATIONAL' end
          from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey >= 5""",
    "vehicles": _REF_VEHICLES,
    "drivers": _REF_DRIVERS,
    "routes": _REF_ROUTES,
    "in_parts": """select event_type, ((seq - (select min(seq) from ship)) * 3) // (select max(seq) - min(seq) + 1 from ship) as part
        from ship""",
    "late": _latest("ship", "shipment_id", """customer_id, warehouse_id, expected_delivery, event_type as current_status,
        destination_city, destination_country, greatest(0, (timestamp - expected_delivery - 1800000) // 60000) as delay_minutes,
        timestamp as last_updated""", _LATE),
    "shipment_last": _latest("ship", "shipment_id", "warehouse_id, event_type as status"),
    "vstate": _latest("tel", "vehicle_id", """driver_id, latitude, longitude, speed_kmh, heading, fuel_level_percent, status,
        weight_kg as current_load_kg, shipment_count as current_load_items, volume_cubic_m as current_load_volume_m3,
        odometer_km, timestamp as last_updated"""),
    "vshown": """select vehicle_id, driver_id, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
        round(speed_kmh, 6) as speed_kmh, round(heading, 6) as heading, round(fuel_level_percent, 6) as fuel_level_percent, status,
        round(current_load_kg, 6) as current_load_kg, current_load_items, round(current_load_volume_m3, 6) as current_load_volume_m3,
        round(odometer_km, 6) as odometer_km, last_updated from vstate""",
    "ostate": f"""select l.*, f.created_at from ({_latest('ords', 'order_id',
        'customer_id, status, priority, shipment_ids, total_items, sla_timestamp, timestamp as last_updated')}) l
        join (select order_id, timestamp as created_at from (select *, row_number() over (partition by order_id order by timestamp, seq) as rn
              from ords) where rn = 1) f using (order_id)""",
    "oshown": """select order_id, customer_id, status, priority, array_to_string(shipment_ids, ',') as shipment_ids, total_items,
        sla_timestamp, last_updated, created_at from ostate""",
    "sla": _latest("ords", "order_id", f"""customer_id, priority, status as current_status, sla_timestamp,
        {_MINUTES} as time_to_sla_minutes, {_MINUTES} between 0 and 60 as is_at_risk, {_MINUTES} < 0 as is_breached,
        cast(len(shipment_ids) as int) as shipment_count, timestamp as last_updated""", _TRACKED),
    "ship_steps": f"""select *, sum(d) over ({_BY_CUSTOMER}) as d_run from (
        select *, case when event_type = 'IN_TRANSIT' then 1 when event_type in ('DELIVERED', 'CANCELLED') then -1 else 0 end as d from ship)""",
    "ship_stats": f"""select customer_id, count_if(event_type = 'CREATED') as total_shipments,
        count_if(event_type = 'DELIVERED') as delivered_count,
        count_if({_OPEN_SHIPMENT} and expected_delivery < timestamp) as late_count,
        count_if(event_type = 'CANCELLED') as cancelled_count, count_if(event_type = 'EXCEPTION') as exception_count,
        count_if(event_type = 'DELIVERED' and timestamp <= expected_delivery + 1800000) as on_time_count,
        max(timestamp) as last_updated, cast(sum(d) - least(0, min(d_run)) as bigint) as in_transit_count
        from ship_steps group by customer_id""",
    "ord_steps": f"""select *, sum(p) over ({_BY_CUSTOMER}) as p_run, sum(d) over ({_BY_CUSTOMER}) as d_run, sum(r) over ({_BY_CUSTOMER}) as r_run
        from (select *, status in ('CANCELLED', 'PARTIAL_FAILURE') as failed,
          case when status = 'RECEIVED' then 1 when status in ('SHIPPED', 'CANCELLED', 'PARTIAL_FAILURE') then -1 else 0 end as p,
          case when status = 'DELIVERED' then 1 when status = 'RETURNED' then -1 else 0 end as d,
          case when status in ('DELIVERED', 'CANCELLED', 'PARTIAL_FAILURE') then -1
            when {_OPEN_ORDER} and {_MINUTES} between 0 and 60 then 1 else 0 end as r from ords)""",
    "ord_pending": f"""select *, {_clamp('p')} as pending, {_clamp('d')} as delivered, {_clamp('r')} as risk
        from ord_steps window w as ({_BY_CUSTOMER})""",
    "ord_shipped": f"""select *, sum(s) over ({_BY_CUSTOMER}) as s_run from (
        select *, case when status = 'SHIPPED' then 1 when status = 'DELIVERED' then -1
          when failed and coalesce(lag(pending) over (partition by customer_id order by timestamp, seq), 0) = 0 then -1 else 0 end as s
        from ord_pending)""",
    "ord_final": f"""select *, {_clamp('s')} as shipped, row_number() over (partition by customer_id order by timestamp desc, seq desc) as rn
        from ord_shipped window w as ({_BY_CUSTOMER})""",
    "ord_stats": """select l.customer_id, t.total_orders, t.cancelled_orders, t.returned_orders, l.timestamp as last_updated,
        cast(pending as bigint) as pending_orders, cast(shipped as bigint) as shipped_orders,
        cast(delivered as bigint) as delivered_orders, cast(risk as bigint) as at_risk_orders
        from ord_final l join (select customer_id, count_if(status = 'RECEIVED') as total_orders,
          count_if(failed) as cancelled_orders, count_if(status = 'RETURNED') as returned_orders from ord_steps group by 1) t
        using (customer_id) where rn = 1""",
    "hourly": """select warehouse_id, start as window_start, start + 3600000 as window_end,
        count_if(timestamp <= expected_delivery + 1800000) as on_time_count,
        count_if(timestamp > expected_delivery + 1800000) as late_count, count(*) as total_delivered,
        round(100.0::double * count_if(timestamp <= expected_delivery + 1800000) / count(*), 6) as on_time_percentage,
        cast(sum(abs(timestamp - expected_delivery)) as bigint) as total_delivery_time_ms,
        round(sum(abs(timestamp - expected_delivery))::double / count(*), 6) as avg_delivery_time_ms, max(timestamp) as last_updated
        from (select *, timestamp - timestamp % 1800000 - unnest([0, 1]) * 1800000 as start from ship where event_type = 'DELIVERED')
        group by warehouse_id, start""",
    "metrics": f"""select warehouse_id, start as window_start, start + 900000 as window_end, count(*) as total_operations,
        cast(sum(duration_seconds) as bigint) as total_duration_seconds,
        round(sum(duration_seconds)::double / count(*), 6) as avg_duration_seconds, count_if(has_error) as error_count,
        cast(sum(quantity) as bigint) as total_items_processed, max(timestamp) as last_updated,
        {', '.join(f"count_if(operation_type = '{t}') as {t.lower()}_count" for t in _OPS)}
        from (select *, timestamp - timestamp % 900000 as start from ops) group by warehouse_id, start""",
    "recent_metrics": """select * exclude (rn) from (select *, row_number() over (partition by warehouse_id order by window_start desc) as rn
        from metrics where window_start between (select max(timestamp) from ops) - 21600000 and (select max(timestamp) from ops)) where rn <= 4""",
    "recent_hourly": """select * exclude (rn) from (select *, row_number() over (partition by warehouse_id order by window_start desc) as rn
        from hourly where window_start between (select max(timestamp) from ship) - 21600000 and (select max(timestamp) from ship)) where rn <= 4""",
    "resources": """select warehouse_id, coalesce(v.n, 0) as total_vehicles, coalesce(v.used, 0) as used_vehicles,
        coalesce(v.ready, 0) as ready_vehicles, coalesce(d.n, 0) as total_drivers, coalesce(d.free, 0) as available_drivers
        from warehouses left join (select home_warehouse_id, count(*) as n, count_if(status = 'IN_USE') as used,
            count_if(status in ('AVAILABLE', 'IN_USE')) as ready from vehicles group by 1) v on v.home_warehouse_id = warehouse_id
        left join (select home_warehouse_id, count(*) as n, count_if(status = 'AVAILABLE') as free from drivers group by 1) d
            on d.home_warehouse_id = warehouse_id""",
    "network": """select coalesce(h.warehouse_id, m.warehouse_id) as warehouse_id, coalesce(hw, 0) as hourly_windows,
        cast(coalesce(dl, 0) as bigint) as delivered, cast(coalesce(ot, 0) as bigint) as on_time, coalesce(mw, 0) as metric_windows,
        cast(coalesce(op, 0) as bigint) as operations, cast(coalesce(er, 0) as bigint) as errors
        from (select warehouse_id, count(*) as hw, sum(total_delivered) as dl, sum(on_time_count) as ot from recent_hourly group by 1) h
        full join (select warehouse_id, count(*) as mw, sum(total_operations) as op, sum(error_count) as er from recent_metrics group by 1) m
        on h.warehouse_id = m.warehouse_id""",
    "first_driver": """select * from (select *, row_number() over (partition by assigned_vehicle_id order by driver_id) as rn
        from drivers where assigned_vehicle_id is not null) where rn = 1""",
    "links": "select distinct order_id, unnest(shipment_ids) as shipment_id from ords",
    "changes": """select shipment_id, seq, timestamp, lag(event_type) over (partition by shipment_id order by timestamp, seq) as from_status,
        event_type as to_status from ship""",
    "extract_customers": "select * exclude (c_acctbal) from customers union all select * from incoming",
    "raw_ids": """select c_custkey, case c_custkey % 6 when 0 then c_name when 1 then ' cust-' || c_custkey || ' '
        when 2 then lower(c_mktsegment) when 3 then cast(c_custkey * 100000007 + 99999999999 as varchar)
        when 4 then '  ' else cast(c_custkey as varchar) end as raw from customer""",
    "clean_ids": r"""select c_custkey, case when trim(raw) = '' then null else trim(upper(raw)) end as t,
        try_cast(regexp_replace(raw, '[^0-9]', '', 'g') as int) as n from raw_ids""",
    "incoming": f"""select printf('CUST-%04d', s_suppkey * 20) as customer_id, s_name as company_name,
        'supplier' || s_suppkey || '@example.com' as contact_email, {_pick('s_nationkey % 4', ('STANDARD', 'EXPRESS', 'SAME_DAY', 'CRITICAL'))} as sla_tier,
        case when s_acctbal < 0 then 'SUSPENDED' when s_acctbal > 9000 then 'REVIEW' else 'ACTIVE' end as account_status from supplier""",
}


def _iso(ms: str) -> str:
    text = f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S')"
    return f"{text} || case when {ms} % 1000 = 0 then 'Z' else printf('.%03dZ', {ms} % 1000) end"


def _id(prefix: str, width: int) -> str:
    return f"case when starts_with(t, '{prefix}') then t when t is not null and n is not null then printf('{prefix}%0{width}d', n) else '{prefix}' || t end"


_STAT_COLUMNS = "* exclude (on_time_count)"
_ZERO_ORDERS = ", ".join(f"coalesce({c}, 0) as {c}" for c in (
    "total_orders", "pending_orders", "shipped_orders", "delivered_orders", "at_risk_orders"))
_NO_NULLS = {
    "customers": ("company_name", "sla_tier"), "warehouses": ("name", "city", "country"),
}

_SELECTS = {
    "status_event_counts": "select event_type as status, count(*) as event_count from ship group by 1",
    "status_counts_zero_filled": """select status, coalesce(n, 0) as event_count from (select unnest(['CREATED', 'PICKED', 'PACKED',
        'DISPATCHED', 'IN_TRANSIT', 'OUT_FOR_DELIVERY', 'DELIVERED', 'EXCEPTION', 'CANCELLED']) as status)
        left join (select event_type, count(*) as n from ship group by 1) on event_type = status""",
    "status_counts_total": """select string_agg(status || '=' || n, ',' order by status) as status_counts, cast(sum(n) as bigint) as total_shipments
        from (select event_type as status, count(*) as n from ship group by 1)""",
    "status_count": """select 'DELIVERED' as status, count(*) as event_count,
        case when count(*) = 0 then 'No shipments found with status: DELIVERED' end as message from ship where event_type = 'DELIVERED'""",
    "current_status_counts": "select status, count(*) as shipment_count from shipment_last group by 1",
    "customer_shipment_stats": f"select {_STAT_COLUMNS} from ship_stats",
    "customer_order_stats": "select * from ord_stats",
    "late_shipments": "select * from late",
    "late_shipments_open": "select late.* from late join shipment_last using (shipment_id) where status not in ('DELIVERED', 'CANCELLED')",
    "vehicle_state": "select * from vshown",
    "order_state": "select * from oshown",
    "order_terminal": "select order_id, status in ('DELIVERED', 'CANCELLED', 'RETURNED') as is_terminal from ostate",
    "order_state_json": f"""select cast(to_json({{'order_id': order_id, 'customer_id': customer_id, 'status': status, 'priority': priority,
        'shipment_ids': shipment_ids, 'total_items': total_items, 'sla_timestamp': sla_timestamp, 'created_at': created_at,
        'last_updated': {_iso('last_updated')}}}) as varchar) as json from ostate""",
    "order_sla_tracking": "select * from sla",
    "order_sla_open": """select sla.* from sla join ostate using (order_id)
        where status not in ('DELIVERED', 'CANCELLED', 'RETURNED', 'PARTIAL_FAILURE')""",
    "sla_severity": """select *, case when is_breached then 'CRITICAL' when time_to_sla_minutes <= 30 then 'HIGH' else 'MEDIUM' end as severity from sla""",
    "hourly_delivery_performance": "select * from hourly",
    "warehouse_metrics": "select * from metrics",
    "last_windows_metrics": "select * from recent_metrics",
    "last_windows_hourly": "select * from recent_hourly",
    "latest_window": "select * from recent_metrics m where window_start = (select max(window_start) from recent_metrics x where x.warehouse_id = m.warehouse_id)",
    "fleet_status": """select status, count(*) as vehicle_count, (select count(*) from vstate) as total_vehicles from vstate
        where status is not null group by 1""",
    "fleet_first": """select *, (select count(*) from vstate) as total, case when (select count(*) from vstate) > 20
        then 'Showing first 20 of ' || (select count(*) from vstate) || ' results' end as note from vshown order by vehicle_id limit 20""",
    "fleet_utilization": """select count(*) as total_vehicles, count_if(status in ('EN_ROUTE', 'LOADING', 'UNLOADING')) as active_vehicles,
        count_if(status = 'IDLE') as idle_vehicles, count_if(status = 'MAINTENANCE') as maintenance_vehicles,
        round(avg(current_load_kg), 6) as average_load_kg, round(avg(fuel_level_percent), 6) as average_fuel_level,
        round(100.0::double * count_if(status in ('EN_ROUTE', 'LOADING', 'UNLOADING')) / count(*), 6) as utilization_rate from vstate""",
    "warehouse_resource_counts": """select warehouse_id, total_vehicles, ready_vehicles as active_vehicles, total_drivers, available_drivers from resources""",
    "table_row_counts": " union all ".join(
        f"select '{t}' as table_name, count(*) as record_count from {t}"
        for t in ("warehouses", "customers", "vehicles", "products", "drivers", "routes")),
    "dashboard_summary": """select 'shipments' as section, unnest(['in_transit', 'delivered', 'created']) as metric,
            unnest([count_if(event_type = 'IN_TRANSIT'), count_if(event_type = 'DELIVERED'), count_if(event_type = 'CREATED')])::double as value from ship
        union all select 'shipments', 'late', count(*)::double from late
        union all select 'vehicles', unnest(['active', 'idle', 'maintenance', 'average_load_percent']),
            round(unnest([count_if(v.status in ('EN_ROUTE', 'LOADING', 'UNLOADING'))::double, count_if(v.status = 'IDLE')::double,
            count_if(v.status = 'MAINTENANCE')::double, avg(current_load_kg / capacity_kg * 100)]), 6)
            from vstate v left join vehicles f on v.vehicle_id = f.vehicle_id
        union all select 'orders', unnest(['pending', 'shipped']),
            unnest([count_if(status in ('RECEIVED', 'VALIDATED', 'ALLOCATED')), count_if(status = 'SHIPPED')])::double from ostate
        union all select 'orders', 'at_risk', count(*)::double from sla
        union all select 'warehouse_operations', warehouse_id, total_operations::double from recent_metrics m
            where window_start = (select max(window_start) from recent_metrics x where x.warehouse_id = m.warehouse_id)""",
    "dashboard_alerts": """(select 'late' as kind, shipment_id as id, delay_minutes as minutes from late order by delay_minutes desc, shipment_id limit 5)
        union all (select 'sla', order_id, time_to_sla_minutes from sla order by time_to_sla_minutes, order_id limit 5)""",
    "network_performance": "select * from network",
    "network_coverage": """select count_if(hourly_windows > 0) as warehouses_with_performance_data,
        count_if(metric_windows > 0) as warehouses_with_metrics_data from network""",
    "customer_overview": f"""select c.customer_id, company_name, contact_email, sla_tier, account_status,
        coalesce(total_shipments, 0) as total_shipments, coalesce(delivered_count, 0) as delivered_shipments,
        coalesce(in_transit_count, 0) as in_transit_shipments, coalesce(exception_count, 0) as exception_shipments, {_ZERO_ORDERS},
        case when delivered_count > 0 then round(100.0::double * on_time_count / delivered_count, 6) else 0.0 end as shipment_on_time_rate,
        case when total_orders > 0 then round((1.0::double - at_risk_orders / total_orders::double) * 100, 6) else 100.0 end as sla_compliance_rate
        from customers c left join ship_stats s on c.customer_id = s.customer_id left join ord_stats o on c.customer_id = o.customer_id""",
    "late_shipments_for_company": """select late.*, company_name, sla_tier, contact_email, w.name as warehouse_name, w.city as warehouse_city
        from late join customers c on late.customer_id = c.customer_id left join warehouses w on late.warehouse_id = w.warehouse_id
        where lower(company_name) like '%customer#00000001%'""",
    "customer_sla_compliance": f"""select c.customer_id, company_name, sla_tier, {_ZERO_ORDERS},
        coalesce(cancelled_orders, 0) as cancelled_orders, coalesce(returned_orders, 0) as returned_orders,
        coalesce(n, 0) as at_risk_orders_count,
        case when total_orders > 0 then round((1.0::double - coalesce(n, 0) / total_orders::double) * 100, 6) else 100.0 end as sla_compliance_rate
        from customers c left join ord_stats o on c.customer_id = o.customer_id
        left join (select customer_id, count(*) as n from sla group by 1) t on c.customer_id = t.customer_id""",
    "customer_tracked_orders": "select company_name, sla_tier, sla.* from sla join customers c on sla.customer_id = c.customer_id",
    "enriched_vehicle_state": """select v.vehicle_id, v.status, v.latitude, v.longitude, v.speed_kmh, v.heading, v.fuel_level_percent,
        v.current_load_kg, v.current_load_volume_m3, v.last_updated as telemetry_timestamp, f.vehicle_type, f.license_plate, f.capacity_kg,
        f.capacity_cubic_m, f.home_warehouse_id, f.fuel_type, d.driver_id, d.first_name || ' ' || d.last_name as driver_name, d.license_type,
        d.certifications, w.name as home_warehouse_name, w.city as home_warehouse_city,
        round(s.current_load_kg / f.capacity_kg * 100, 6) as load_percentage
        from vshown v join vstate s on v.vehicle_id = s.vehicle_id join vehicles f on v.vehicle_id = f.vehicle_id
        left join first_driver d on d.assigned_vehicle_id = v.vehicle_id
        left join warehouses w on w.warehouse_id = f.home_warehouse_id""",
    "driver_tracking": """select d.driver_id, d.first_name || ' ' || d.last_name as driver_name, license_type, certifications, d.status,
        assigned_vehicle_id, v.status as vehicle_status, v.speed_kmh, v.latitude, v.longitude, v.last_updated
        from drivers d left join vshown v on v.vehicle_id = d.assigned_vehicle_id""",
    "warehouse_operational_status": """select w.warehouse_id, name, city, country, status, round(latitude, 6) as latitude, round(longitude, 6) as longitude,
        r.total_vehicles, r.used_vehicles as active_vehicles, r.total_drivers, r.available_drivers,
        coalesce(m.t, '') as operations_by_window, coalesce(h.t, '') as deliveries_by_window,
        name || ' in ' || city || ' has ' || r.total_vehicles || ' vehicles and ' || r.total_drivers || ' drivers and is ' || status as summary
        from warehouses w join resources r on w.warehouse_id = r.warehouse_id
        left join (select warehouse_id, string_agg(window_start || ':' || total_operations, ',' order by window_start) as t from recent_metrics group by 1) m
          on m.warehouse_id = w.warehouse_id
        left join (select warehouse_id, string_agg(window_start || ':' || total_delivered, ',' order by window_start) as t from recent_hourly group by 1) h
          on h.warehouse_id = w.warehouse_id""",
    "order_details": """select o.*, company_name, sla_tier, contact_email, time_to_sla_minutes, is_at_risk, is_breached, s.last_updated as sla_last_updated,
        o.order_id || ' stands at ' || o.status || ' for ' || coalesce(company_name, o.customer_id) as summary
        from oshown o left join customers c on o.customer_id = c.customer_id left join sla s on o.order_id = s.order_id""",
    "lookup_vehicle_state": "select * from vshown where vehicle_id in (select assigned_vehicle_id from drivers where status = 'AVAILABLE')",
    "lookup_customer_shipment_stats": f"""select {_STAT_COLUMNS} from ship_stats
        where customer_id in (select customer_id from customers where sla_tier = 'CRITICAL')""",
    "lookup_late_shipments": "select * from late where shipment_id in (select shipment_id from ops where has_error)",
    "lookup_warehouse_metrics": "select * from recent_metrics where warehouse_id in (select warehouse_id from warehouses where country <> 'Spain')",
    "lookup_hourly_performance": "select * from recent_hourly where warehouse_id in (select warehouse_id from warehouses where country <> 'Spain')",
    "lookup_order_state": "select * from oshown where order_id in (select order_id from ords where status = 'CANCELLED')",
    "lookup_customer_order_stats": """select * from ord_stats
        where customer_id in (select customer_id from customers where account_status = 'SUSPENDED')""",
    "lookup_order_sla_tracking": "select * from sla where order_id in (select order_id from ords where priority = 'CRITICAL')",
    "lookup_one_vehicle_state": "select * from vshown where vehicle_id = 'VEH-007'",
    "lookup_one_customer_shipment_stats": f"select {_STAT_COLUMNS} from ship_stats where customer_id = 'CUST-0007'",
    "lookup_one_customer_order_stats": "select * from ord_stats where customer_id = 'CUST-0007'",
    "lookup_one_late_shipment": "select * from late where shipment_id = 'SH-7-3'",
    "lookup_one_order_state": "select * from oshown where order_id = 'ORD-00037'",
    "lookup_one_order_sla": "select * from sla where order_id = 'ORD-00037'",
    "lookup_one_warehouse_metrics": "select * from recent_metrics where warehouse_id = 'WH-STO'",
    "lookup_one_hourly_performance": "select * from recent_hourly where warehouse_id = 'WH-STO'",
    "ref_warehouses": "select * from warehouses",
    "ref_warehouse_by_id": "select * from warehouses where warehouse_id = 'WH-RTM'",
    "ref_warehouses_by_city": "select * from warehouses where lower(city) like '%r%'",
    "ref_customers_page": "select * exclude (c_acctbal) from customers order by customer_id limit 50 offset 100",
    "ref_customer_by_id": "select * exclude (c_acctbal) from customers where customer_id = 'CUST-0007'",
    "ref_customers_by_company": "select * exclude (c_acctbal) from customers where lower(company_name) like '%customer#00000007%'",
    "ref_customers_by_tier": "select * exclude (c_acctbal) from customers where sla_tier = 'EXPRESS'",
    "ref_vehicles": "select * from vehicles",
    "ref_vehicle_by_id": "select * from vehicles where vehicle_id = 'VEH-007'",
    "ref_vehicles_by_warehouse": "select * from vehicles where home_warehouse_id = 'WH-STO'",
    "ref_products_by_category": "select * from products where category = 'ECONOMY' order by product_id limit 20 offset 5",
    "ref_products_search": "select * from products where lower(name) like '%ring%' or lower(sku) like '%ring%' order by product_id limit 15",
    "ref_drivers": "select * from drivers",
    "ref_driver_by_id": "select * from drivers where driver_id = 'DRV-002'",
    "ref_drivers_by_warehouse": "select * from drivers where home_warehouse_id = 'WH-STO'",
    "ref_drivers_available": "select * from drivers where status = 'AVAILABLE'",
    "ref_routes": "select * from routes",
    "ref_routes_by_origin": "select * from routes where origin_warehouse_id = 'WH-STO'",
    "ref_routes_by_destination": "select * from routes where lower(destination_city) like '%an%'",
    "ref_vehicles_by_warehouse_count": "select count(*) as count from vehicles where home_warehouse_id = 'WH-STO'",
    "ref_drivers_available_count": "select count(*) as count from drivers where status = 'AVAILABLE'",
    "ref_routes_by_origin_count": "select count(*) as count from routes where origin_warehouse_id = 'WH-STO'",
    "ref_products_category_first": "select * from products where category = 'STANDARD' order by product_id limit 12",
    "ref_products_search_next": "select * from products where lower(name) like '%ring%' or lower(sku) like '%ring%' order by product_id limit 12",
    "ref_products_listed": "select * from products order by product_id limit 12",
    "ref_distinct_destinations": "select destination_city, destination_country, min(route_id) as first_route_id from routes group by 1, 2",
    "insert_if_absent": """select * exclude (c_acctbal) from customers
        union all select * from incoming where customer_id not in (select customer_id from customers)""",
    "normalize_ids": f"""select c_custkey, {_id('CUST-', 4)} as as_customer, {_id('VEH-', 3)} as as_vehicle,
        case when starts_with(t, 'WH-') then t else 'WH-' || t end as as_warehouse, {_id('ORD-', 5)} as as_order from clean_ids""",
    "customer_search_top": """select * exclude (c_acctbal), count(*) over () as total,
        case when count(*) over () > 10 then 'Showing first 10 of ' || count(*) over () || ' results' end as note
        from customers where lower(company_name) like '%customer#0000000%' order by customer_id limit 10""",
    "late_top_k": """select *, count(*) over () as total, case when count(*) over () > 10
        then 'Showing first 10 of ' || count(*) over () || ' results' end as note from late order by delay_minutes desc, shipment_id limit 10""",
    "at_risk_top_k": """select *, count(*) over () as total, case when count(*) over () > 10
        then 'Showing first 10 of ' || count(*) over () || ' results' end as note from sla order by time_to_sla_minutes, order_id limit 10""",
    "order_rollup": """select order_id, case when bool_or(had_exception) then 'PARTIAL_FAILURE' when bool_and(status = 'CANCELLED') then 'CANCELLED'
        when min(case when status <> 'CANCELLED' then pos end) >= 6 then 'DELIVERED'
        when min(case when status <> 'CANCELLED' then pos end) >= 3 then 'SHIPPED' end as derived_status
        from (select order_id, unnest(shipment_ids) as shipment_id from ostate) l
        left join (select s.shipment_id, s.status, e.had_exception, coalesce(list_position(['CREATED', 'PICKED', 'PACKED', 'DISPATCHED',
              'IN_TRANSIT', 'OUT_FOR_DELIVERY', 'DELIVERED'], s.status), 0) - 1 as pos
            from shipment_last s join (select shipment_id, bool_or(event_type = 'EXCEPTION') as had_exception from ship group by 1) e
            on s.shipment_id = e.shipment_id) k on l.shipment_id = k.shipment_id group by order_id""",
    "open_shipments_by_warehouse": "select warehouse_id, shipment_id, status from shipment_last where status not in ('DELIVERED', 'CANCELLED')",
    "pickable_shipments": "select shipment_id, warehouse_id from shipment_last where status = 'CREATED'",
    "order_shipment_links": "select order_id, shipment_id from links",
    "shipment_order_map": """select shipment_id, order_id from (select shipment_id, order_id, row_number() over
        (partition by shipment_id order by timestamp desc, seq desc) as rn
        from (select timestamp, seq, order_id, unnest(shipment_ids) as shipment_id from ords)) where rn = 1""",
    "order_deadlines": """select order_id, priority, created_at, created_at + 3600000 * case priority when 'STANDARD' then 120
        when 'EXPRESS' then 48 when 'SAME_DAY' then 12 else 4 end as deadline from ostate""",
    "lifecycle_violations": """select * from changes where from_status is not null and from_status || '>' || to_status not in (
        'CREATED>PICKED', 'CREATED>CANCELLED', 'PICKED>PACKED', 'PACKED>DISPATCHED', 'DISPATCHED>IN_TRANSIT',
        'IN_TRANSIT>OUT_FOR_DELIVERY', 'IN_TRANSIT>EXCEPTION', 'EXCEPTION>EXCEPTION', 'EXCEPTION>OUT_FOR_DELIVERY',
        'OUT_FOR_DELIVERY>DELIVERED')""",
    "reference_violations": """select 'customers' as table_name, 'domain:account_status' as rule, customer_id as key from extract_customers
            where account_status not in ('ACTIVE', 'SUSPENDED', 'CLOSED')
        union all select 'customers', 'domain:sla_tier', customer_id from extract_customers
            where sla_tier not in ('STANDARD', 'EXPRESS', 'SAME_DAY', 'CRITICAL')
        union all select 'customers', 'unique:customer_id', customer_id from extract_customers group by customer_id having count(*) > 1
        union all select 'vehicles', 'foreign_key:home_warehouse_id', vehicle_id from vehicles
            where home_warehouse_id not in (select warehouse_id from warehouses)
        union all select 'vehicles', 'not_null:home_warehouse_id', vehicle_id from vehicles where home_warehouse_id is null
        union all select 'drivers', 'foreign_key:home_warehouse_id', driver_id from drivers
            where home_warehouse_id not in (select warehouse_id from warehouses)
        union all select 'drivers', 'foreign_key:assigned_vehicle_id', driver_id from drivers
            where assigned_vehicle_id not in (select vehicle_id from vehicles)
        union all select 'routes', 'foreign_key:origin_warehouse_id', route_id from routes
            where origin_warehouse_id not in (select warehouse_id from warehouses)
        union all select 'products', 'unique:sku', sku from products group by sku having count(*) > 1""",
    "decoded_props": """select event_type, count_if(json_valid(props)) as readable, count_if(not json_valid(props)) as set_aside,
        cast(coalesce(sum(case when json_valid(props) then cast(json_extract_string(props, '$.k') as int) end), 0) as bigint) as total_k
        from (select event_type, case when event_id % 9 = 4 then left(props, -1) else props end as props from events) group by 1""",
    "event_times_iso": f"select seq, {_iso('timestamp')} as at, {_iso('expected_delivery')} as expected_at from ship",
}
_SELECTS["lenient_props"] = """select event_type, cast(sum(k) as bigint) as total_k, count_if(k = -1) as defaults, count(*) * 0.5::double as total_missing
    from (select event_type, case when json_valid(props) then coalesce(try_cast(json_extract_string(props, '$.k') as int), -1) else -1 end as k
        from (select event_type, case when event_id % 9 = 4 then left(props, -1) else props end as props from events)) group by 1"""
_ARRIVAL = "timestamp + (seq * 7919 % 97) * 60000, seq"
_SELECTS |= {
    "ref_products_page_deep": """select * exclude (rn) from (select *, row_number() over (order by product_id) as rn from products)
        where rn > (select count(*) // 2 + 7 from products) and rn <= (select count(*) // 2 + 32 from products)""",
    "ref_products_page_next": "select * from products where product_id > 'PROD-000100' order by product_id limit 25",
    "late_deliveries": f"""select seq, warehouse_id, timestamp, stream_time, window_start, window_start + 3600000 as window_end
        from (select *, unnest([timestamp - timestamp % 1800000, timestamp - timestamp % 1800000 - 1800000]) as window_start
            from (select seq, warehouse_id, timestamp, max(timestamp) over (order by {_ARRIVAL} rows unbounded preceding) as stream_time
                from ship where event_type = 'DELIVERED'))
        where window_start + 3600000 + 300000 <= stream_time""",
    "late_operations": f"""select seq, warehouse_id, timestamp, stream_time, timestamp - timestamp % 900000 as window_start,
            timestamp - timestamp % 900000 + 900000 as window_end
        from (select seq, warehouse_id, timestamp,
            max(timestamp) over (partition by warehouse_id order by {_ARRIVAL} rows unbounded preceding) as stream_time from ops)
        where timestamp - timestamp % 900000 + 900000 <= stream_time""",
    "stream_recent_hourly": "select * from hourly where window_start >= (select max(window_start) from hourly) - 21600000",
    "stream_recent_metrics": "select * from metrics where window_start >= (select max(window_start) from metrics) - 21600000",
    "stream_shipment_views": """select 'status_event_counts' as view, event_type as key, count(*) as a, count(*) as b, count(*) as c from ship group by 2
        union all select 'customer_shipment_stats', customer_id, in_transit_count, late_count, last_updated from ship_stats
        union all select 'late_shipments', shipment_id, delay_minutes, expected_delivery, last_updated from late
        union all select 'hourly_delivery_performance', warehouse_id || '|' || window_start, on_time_count, total_delivered,
            total_delivery_time_ms from hourly""",
    "stream_resumed_order_views": """select 'order_state' as view, order_id as key, created_at as a, sla_timestamp as b, last_updated as c from ostate
        union all select 'customer_order_stats', customer_id, pending_orders, shipped_orders, at_risk_orders from ord_stats
        union all select 'order_sla_tracking', order_id, time_to_sla_minutes, shipment_count, last_updated from sla""",
    "stream_state_at_batch": "select event_type as status, count(*) as count from in_parts where part < 2 group by 1",
    "view_changes": """select batch_id, status, lag(after) over (partition by status order by batch_id) as before, after from (
        select part as batch_id, event_type as status,
            cast(sum(count(*)) over (partition by event_type order by part) as bigint) as after from in_parts group by 1, 2)""",
}
_STREAMED = {
    "stream_set_aside": "decoded_props",
    "stream_status_event_counts": "status_event_counts", "stream_customer_shipment_stats": "customer_shipment_stats",
    "stream_late_shipments": "late_shipments", "stream_hourly_performance": "hourly_delivery_performance",
    "stream_vehicle_state": "vehicle_state", "stream_warehouse_metrics": "warehouse_metrics",
    "stream_order_state": "order_state", "stream_customer_order_stats": "customer_order_stats",
    "stream_order_sla_tracking": "order_sla_tracking",
}


def _complete(select: str) -> str:
    """Put the named parts that a SELECT mentions, directly or through others, in front of it."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for name, sql in _PARTS.items():
            if name not in wanted and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                add(sql)
                if name not in wanted:
                    wanted.append(name)

    add(select)
    head = ", ".join(f"{name} as ({_PARTS[name]})" for name in wanted)
    return f"with {head} {select}" if head else select


def oracle_queries() -> dict[str, str]:
    out = {name: _complete(sql) for name, sql in _SELECTS.items()}
    out.update({name: out[base] for name, base in _STREAMED.items()})
    return out
