"""DuckDB SQL with the same rows as the registered queries.

The views are stated in closed form from the test tables, so that SQL and DataFrame code share no step.
"""

from __future__ import annotations

VIEWS = """
e0 as (select event_id e, user_id u, event_type, cast(round(value * 100) as bigint) cents, epoch_us(ts) // 5000000 seq,
  row_number() over (partition by epoch_us(ts) // 5000000 order by event_id) - 1 r from events),
ev as (select e, u, cents, seq, r // 3 + 1 tx, r % 3 idx, (r % 3) // 2 op, (r % 3) % 2 pos, 'C' || u contract,
  case event_type when 'view' then 'transfer' when 'click' then 'mint' when 'purchase' then 'burn' when 'signup' then 'clawback' else 'error' end nm,
  printf('%019d-%010d', (seq << 32) + ((r // 3 + 1) << 12), r % 3) id, md5(seq || ':' || (r // 3 + 1)) tx_hash,
  (seq + r // 3 + 1) % 11 <> 0 ok, (seq + r // 3 + 1) % 17 <> 0 readable, e % 50 <> 0 v0, 'G' || u a, 'C' || ((u * 7 + e) % 1000) b,
  case when e % 4 = 0 then 'native' else 'USD:G1' end asset,
  case when e % 13 = 0 then '-' || (cents + 1) else cast(cents as varchar) end txt from e0),
env as (select *, to_base64(encode(nm)) t0,
  to_base64(encode(case when nm = 'mint' and e % 2 = 1 then b else a end)) t1,
  to_base64(encode(case when nm = 'transfer' and e % 10 = 3 then null when nm = 'burn' or (nm = 'mint' and e % 2 = 1) then asset else b end)) t2,
  case when nm = 'burn' or (nm = 'mint' and e % 2 = 1) or (nm = 'transfer' and e % 10 = 3) then null else to_base64(encode(asset)) end t3,
  to_base64(encode(txt)) vb,
  case when nm = 'transfer' and e % 10 = 3 then 'addresses' when e % 25 = 1 then 'value' when starts_with(txt, '-') then 'negative' end bad,
  case when nm in ('transfer', 'burn') then a when nm = 'clawback' then b end f, case when nm in ('transfer', 'mint') then b end t,
  case when e % 5 in (0, 1) then cast(e as varchar) end muxed
  from ev where ok and nm <> 'error'),
reg as (select u, 'C' || u contract_id, case when u % 2 = 0 then 'admin' else 'config' end source,
  case u % 4 when 0 then ['events', 'transfers', 'movements'] when 1 then ['events'] when 2 then ['events', 'state', 'trustlines'] else ['state', 'transfers', 'movements'] end kinds,
  1700000000 + u % 50 registered from (select distinct user_id u from events) where u % 3 <> 0),
bf as (select u, contract_id, u % 7 * 500 + 1 target_from, u * 37 % 20000 next_to, u * 37 % 20000 < u % 7 * 500 + 1 done,
  case when u % 6 = 1 then u * 37 % 20000 + 1 end clamped_at, case when u % 8 = 1 then kinds[1:1] else kinds end covered from reg where u % 5 <> 0),
rq as (select u, contract_id, u % 5 * 400 + 1 target_from, 25000::bigint anchor,
  case when u % 10 = 1 then (case when list_contains(kinds, 'trustlines') then kinds else list_append(kinds, 'trustlines') end) when u % 10 = 2 then kinds[1:1] else kinds end kinds from reg where u % 2 = 1),
stored as (select * from env where v0 and contract in (select contract_id from reg where list_contains(kinds, 'events'))),
led as (select seq ledger_sequence, md5(cast(seq as varchar)) hash,
  case when seq % 97 = 0 then md5('tampered') else md5(cast(seq - 1 as varchar)) end previous_hash from (select distinct seq from e0)),
top as (select max(ledger_sequence) cursor from led),
st as (select printf('%019d-%010d', ((l_shipdate::date - date '1970-01-01') << 32) + (l_orderkey << 12), l_linenumber) id, 'C' || l_suppkey contract_id, l_suppkey,
  (l_shipdate::date - date '1970-01-01')::bigint ledger_sequence, md5(cast(l_orderkey as varchar)) tx_hash, l_linenumber change_index,
  case l_returnflag when 'A' then 'created' when 'N' then 'updated' else 'removed' end change_type, 'K' || l_partkey key_xdr,
  case when l_linestatus = 'O' then 'persistent' else 'temporary' end durability, to_base64(encode(cast(cast(round(l_extendedprice * 100) as bigint) as varchar))) body from lineitem),
st1 as (select *, case when change_type <> 'removed' then body end post_value, case when change_type <> 'created' then body end pre_value from st),
ste as (select contract_id, key_xdr, durability, ledger_sequence last_ledger, post_value "value", change_type = 'removed' deleted from st1
  qualify row_number() over (partition by contract_id, key_xdr, durability order by ledger_sequence desc, id desc, post_value desc nulls last) = 1),
stw as (select * from st1 where l_suppkey % 4 <> 0 and l_suppkey in (select s_suppkey from supplier)),
stwe as (select contract_id, key_xdr, durability, ledger_sequence last_ledger, post_value "value", change_type = 'removed' deleted from stw
  qualify row_number() over (partition by contract_id, key_xdr, durability order by ledger_sequence desc, id desc, post_value desc nulls last) = 1),
tl as (select printf('%019d-%010d', ((o_orderdate::date - date '1970-01-01') << 32) + (o_orderkey << 12), 0) id, 'S' || c_nationkey contract_id, 'G' || o_custkey account_id, 'A' || c_nationkey asset,
  (o_orderdate::date - date '1970-01-01')::bigint ledger_sequence, case o_orderstatus when 'O' then 'created' when 'F' then 'updated' else 'removed' end change_type,
  cast(round(o_totalprice * 100) as bigint) cents, o_orderkey % 4 flags from orders join customer on o_custkey = c_custkey
  where o_orderkey % 19 <> 0 and c_nationkey in (select n_nationkey from nation)),
tl1 as (select *, case when change_type <> 'created' then cents - 1 end pre_balance, case when change_type <> 'removed' then cents end post_balance,
  case when change_type <> 'removed' then 1000000000000 end post_limit from tl),
tle as (select contract_id, account_id, ledger_sequence last_ledger, asset, post_balance balance, flags, change_type = 'removed' deleted from tl1
  qualify row_number() over (partition by contract_id, account_id order by ledger_sequence desc, id desc) = 1),
tr as (select printf('%019d-%010d', ((o_orderdate::date - date '1970-01-01') << 32) + (o_orderkey << 12), 0) id, 'C' || (o_custkey % 25) contract_id,
  (o_orderdate::date - date '1970-01-01')::bigint ledger_sequence, case o_orderstatus when 'F' then 'transfer' when 'O' then 'mint' else 'burn' end transfer_type,
  case when o_orderstatus <> 'O' then 'G' || o_custkey end "from", case when o_orderstatus in ('F', 'O') then 'G' || (o_orderkey % 1500) end "to",
  cast(cast(round(o_totalprice * 100) as bigint) as varchar) amount from orders),
mv as (select contract_id, transfer_id, role, token_contract_id, transfer_type, counterparty, amount, ledger_sequence from (
  select "from" contract_id, id transfer_id, 'sender' role, contract_id token_contract_id, transfer_type, "to" counterparty, amount, ledger_sequence from tr
  union all select "to", id, 'recipient', contract_id, transfer_type, "from", amount, ledger_sequence from tr)
  where contract_id in (select 'G' || c_custkey from customer where c_custkey % 2 = 0)),
gp as (select distinct 'gap:testnet:' || (o_orderkey * 10) || ':' || (o_orderkey * 10 + o_orderkey % 9) id, o_orderkey o, o_orderkey * 10 from_sequence, o_orderkey * 10 + o_orderkey % 9 to_sequence,
  o_orderstatus = 'P' resolved, case when o_orderkey % 4 = 0 then o_orderkey * 10 + o_orderkey % 9 - 1 end heal_next_to from orders),
mt as (select event_type metric, 'shard=' || (event_id % 3) labels, ts, event_id % 500 v, lag(event_id % 500) over (partition by event_type, event_id % 3 order by ts, event_id % 500) b from events),
dl as (select metric, labels, epoch_us(ts) // 300000000 * 300 window_start, case when v >= b then v - b else v end delta from mt where b is not null)
"""
PARTS = {
    "event": "id, contract contract_id, nm event_name, t0 topic0, t1 topic1, vb value_b64",
    "move": "contract_id, transfer_id, role, token_contract_id, transfer_type, counterparty, amount",
    "transfer": 'id, contract_id, transfer_type, "from", "to", amount',
    "state": 'contract_id, key_xdr, durability, last_ledger, "value", deleted',
    "line": "contract_id, account_id, last_ledger, asset, balance, flags, deleted",
}
NAMED = "nm in ('transfer', 'mint', 'burn', 'clawback') and v0"
HAS = "list_contains((select kinds from reg where contract_id = contract), '{k}')"
WATCH = "contract in (select contract_id from reg where list_contains(kinds, '{k}'))"
MOVING = "(select contract_id from reg where list_contains(kinds, 'movements'))"
#: The second address is the only contract in any later topic, where it is there at all.
NAMES_WATCHED = f"nm <> 'burn' and not (nm = 'transfer' and e % 10 = 3) and b in {MOVING}"
SPEC = """spec as (select distinct l_suppkey s, l_partkey p, 'C' || l_suppkey contract_id, 'nft_minted' || l_partkey || '_by_owner' snake, (l_suppkey % 4 = 1) and (l_partkey % 2 = 0) is_event,
  l_partkey % 3 <> 0 readable from lineitem),
cls as (select contract_id, case s % 4 when 0 then 'sac' when 3 then 'external' else 'wasm' end type, case when s % 4 in (1, 2) then md5(cast(s as varchar)) end wasm_hash,
  coalesce(string_agg(case when is_event and readable then snake end, ',' order by p), '') ev, coalesce(string_agg(case when not is_event and readable then snake end, ',' order by p), '') fn from spec group by contract_id, s)"""


def _page(table: str, columns: str, order: str, limit: int = 100) -> str:
    return f"select {columns}, (select count(*) from {table}) > {limit} has_more from {table} order by {order} limit {limit}"


def _vouched(page: str, contract: str, kind: str, first: int = 1, last: int = 0, scan: bool = True) -> str:
    """A page beside what it can vouch for; the contract is registered with the kind."""
    status = f"""case when m then 'HAS_MORE' when {last} = 0 or {last} > cursor then 'WAITING_FOR_LEDGERS' when {first} < from_ledger then 'OLDEST_REACHED' else 'COMPLETE' end"""
    return f"""select p.* exclude (has_more), from_ledger, to_ledger, pending, clamped_at, m has_more{f', {status} status' if scan else ''} from
      (select cursor, greatest(case when k then next_to + 1 else cursor end, {first}) from_ledger, {f'least(cursor, {last})' if last else 'cursor'}::bigint to_ledger, w and case when k then not done else true end pending,
        case when k then clamped_at end clamped_at, coalesce((select bool_or(has_more) from ({page})), false) m from
        (select cursor, bf.u is not null w, coalesce(list_contains(covered, '{kind}'), false) k, next_to, done, clamped_at from top left join bf on contract_id = '{contract}'))
      left join ({page}) p on true"""


#: Coverage of each of a registration's kinds, as text.
COVERED = """coalesce((select string_agg(concat_ws(':', kind, greatest(case when k then next_to + 1 else cursor end, 1), cursor, w and case when k then not done else true end, case when k then clamped_at end), ',' order by place) from
      (select kind, place, bf.u is not null w, coalesce(list_contains(covered, kind), false) k, next_to, done, clamped_at, cursor from top
       join (values ('events', 0), ('state', 1), ('transfers', 2), ('trustlines', 3), ('movements', 4)) v(kind, place) on list_contains(reg.kinds, kind) left join bf on bf.contract_id = reg.contract_id)), '') coverage"""

P = PARTS
BODIES = {
    "S1_read_ledgers": "select ledger_sequence, hash from led, (select min(ledger_sequence) lo from led) where ledger_sequence between lo + 1000 and lo + 200000",
    "S5_append_idempotent": """select id, contract_id, key_xdr, change_type from st1 where (contract_id, tx_hash, change_index) not in (select (contract_id, tx_hash, change_index) from st1 where ledger_sequence % 2 = 0)
      qualify row_number() over (partition by contract_id, tx_hash, change_index order by id, key_xdr, post_value nulls first) = 1""",
    "S4_static_snapshot": "select contract_id, source, array_to_string(kinds, ',') kinds from reg where contract_id = 'C1'",
    "S7_export_page": """select '{"id":"' || id || '","contract_id":"' || contract_id || '","closed_at":"' || strftime(make_timestamp((ledger_sequence * 86400 + length(amount)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') || '","transfer_type":"' || transfer_type
      || '"' || coalesce(',"from":"' || "from" || '"', '') || coalesce(',"to":"' || "to" || '"', '') || ',"amount":"' || amount || '"}' record from tr""",
    "F1_successful_only": "select seq ledger_sequence, count(*) n from ev where ok group by seq",
    "F2_contract_events_only": "select seq ledger_sequence, tx::int tx_index, idx::int event_index, contract contract_id from ev where nm <> 'error'",
    "F3_watched": f"select {P['event']} from stored",
    "F4_any_kind": "select kind, exists (select 1 from reg where list_contains(kinds, kind)) registered from (select unnest(['events', 'state', 'transfers', 'trustlines', 'movements', 'none']) kind)",
    "F5_ledger_bounds": "select id, contract_id, key_xdr, change_type from st1 where ledger_sequence between 9000 and 9500",
    "F6_topic_filter": "select id, contract contract_id, t0 topic0, t1 topic1 from env where nm = 'transfer'",
    "F7_account_filter": f"""select {P['transfer']} from tr where "from" = 'G7' or "to" = 'G7'""",
    "F8_transfer_type": f"select {P['transfer']} from tr where transfer_type = 'mint'",
    "F9_role_and_token": f"select {P['move']} from mv where role = 'sender' and token_contract_id = 'C3'",
    "F10_key_and_holder": f"select {P['state']} from ste where key_xdr = 'K5' union all select contract_id, account_id, asset, last_ledger, cast(balance as varchar), deleted from tle where account_id = 'G7'",
    "F11_live_only": f"select {P['state']} from ste where not deleted",
    "F12_keyset_after": f"select {P['move']} from mv where (contract_id, role) > ('G4', 'recipient')",
    "F13_participates_watched": f"select id, contract contract_id, nm event_name from env where {NAMES_WATCHED}",
    "F14_movement_named": f"select id, contract contract_id, nm event_name from env where {NAMED}",
    "P1_event_index": "select seq ledger_sequence, tx::int tx_index, op::int op_index, pos::int pos_in_op, idx::int event_index from ev",
    "P2_change_index": "select l_orderkey, l_partkey, (row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_extendedprice, l_linenumber) - 1)::int change_index from lineitem",
    "P3_chain_order_id": "select id, ledger_sequence, change_index from st1",
    "P4_event_envelope": """select id, contract contract_id, tx_hash, idx::int event_index, nm event_name, t0 topic0, t1 topic1, t2 topic2, t3 topic3, concat_ws(',', t0, t1, t2, t3) topics, vb value_b64,
      to_base64(encode('e' || e)) raw_b64 from env""",
    "P5_decode_transfers": f'select id, nm transfer_type, f "from", t "to", txt amount, asset, muxed to_muxed_id from env where {NAMED} and bad is null',
    "P6_decode_value": f"select id, bad reject_reason, case when bad is null then try_cast(txt as bigint) end amount from env where {NAMED}",
    "P7_muxed_id": f"select id, muxed to_muxed_id from env where {NAMED} and bad is null and muxed is not null",
    "P8_attribute_movements": f"select {P['move']} from mv",
    "P9_state_changes": "select id, contract_id, change_type, key_xdr, durability, pre_value, post_value from stw",
    "P10_trustline_changes": "select id, contract_id, account_id, asset, change_type, pre_balance, post_balance, post_limit, flags from tl1",
    "P11_asset_to_contract": "select 'S' || c_nationkey contract_id, 'A' || c_nationkey asset, count(*) n from orders join customer on o_custkey = c_custkey where c_nationkey in (select n_nationkey from nation) group by c_nationkey",
    "P12_rederive_transfers": f'select id, contract contract_id, nm transfer_type, f "from", t "to", txt amount from stored where bad is null',
    "P13_snake_case": "select distinct contract_id, 'NFTMinted' || p || 'ByOwner' as name, snake from spec",
    "P14_classify_contracts": """select contract_id, type, wasm_hash, case when type = 'sac' then 'approve,burn,clawback,mint,set_admin,set_authorized,transfer' when type = 'external' then '' when ev <> '' then ev else fn end events,
      case when type = 'sac' then 'sac_builtin' when type = 'external' then 'opaque' when ev <> '' then 'spec_events' when fn <> '' then 'function_names' else 'opaque' end as method from cls""",
    "P15_default_kinds": "select contract_id, type, case when type = 'sac' then 'events,state,transfers' else 'events,state' end kinds from cls",
    "J1_pending_backfills": "select contract_id, target_from, next_to from bf where not done",
    "J5_new_against_stored": f"select {P['transfer']} from (select *, substr(id, 21) k, id i2 from tr) where ledger_sequence % 3 <> 0",
    "J6_event_with_transfer": f"select id, nm event_name, nm transfer_type, txt amount from stored where bad is null and {WATCH.format(k='transfers')}",
    "A1_event_counts": "select contract contract_id, nm event_name, count(*) n from stored group by 1, 2",
    "A2_state_entries": "select contract_id, count(*) n from ste where not deleted group by 1",
    "A3_open_counts": "select (select count(*) from gp where not resolved) open_gaps, (select count(*) from bf where not done) pending_walks",
    "A4_state_snapshot": f"select {P['state']} from stwe",
    "A5_trustline_snapshot": f"select {P['line']} from tle",
    "A6_extraction_audit": f"""select ledger_sequence, failed_txs, suppressed_txs, coalesce(se, 0) suppressed_events, coalesce(st, 0) suppressed_transfers, coalesce(fu, 0) foreign_undecodable from
      (select seq ledger_sequence, count(distinct tx) filter (not ok) failed_txs, count(distinct tx) filter (ok and not readable) suppressed_txs from ev group by 1)
      left join (select seq ledger_sequence, count(*) filter (not v0 and {WATCH.format(k='events')}) se, count(*) filter ({NAMED} and bad is not null and {WATCH.format(k='transfers')}) st,
        count(*) filter ({NAMED} and bad is not null and not ({WATCH.format(k='transfers')}) and {NAMES_WATCHED}) fu from env group by 1) using (ledger_sequence)""",
    "A7_contract_summary": f"""select contract_id, coalesce(total, 0) events_total, coalesce(names, '') events_by_name, coalesce(states, 0) state_entries, {COVERED} from reg
      left join (select contract_id, cast(sum(n) as bigint) total, string_agg(nm || '=' || n, ',' order by nm) names from (select contract contract_id, nm, count(*) n from stored group by 1, 2) group by 1) using (contract_id)
      left join (select contract_id, count(*) states from ste where not deleted group by 1) using (contract_id)""",
    "L1_page": _page("tr", "id, amount", "id", 50),
    "L2_paginate_accounts": """select contract_id, cast(ceil(n / 7) as int) page, count(*) n_rows, max_by(account_id, n) last_account_id from
      (select *, row_number() over (partition by contract_id order by account_id) n from (select distinct contract_id, account_id from tl)) group by 1, 2""",
    "L2_paginate_all": """select contract_id, cast(ceil(n / 5) as int) page, count(*) n_rows, max_by(transfer_id, n) last_transfer_id, max_by(role, n) last_role from
      (select *, row_number() over (partition by contract_id order by transfer_id, role) n from mv) group by 1, 2""",
    "L3_resume_key": """select '{"version":1,"endpoint":"movements","network":"testnet","contract":"G4","limit":3,"role":"any","last":{"transfer_id":"' || transfer_id || '","role":"' || role || '"}}' resume_key
      from (select * from mv where contract_id = 'G4' order by transfer_id, role limit 3) order by transfer_id desc, role desc limit 1""",
    "L4_chain_order": "select contract_id, cast(ceil(n / 100) as int) page, count(*) n_rows, max(id) last_id from (select *, row_number() over (partition by contract_id order by id) n from st1) group by 1, 2",
    "I1_continuity_breaks": "select b.ledger_sequence, b.previous_hash, a.hash expected from led b join led a on b.ledger_sequence = a.ledger_sequence + 1 where b.previous_hash <> a.hash",
    "I2_sequence_gaps_bounded": """select s + 1 from_sequence, n - 1 to_sequence from (select s, lead(s) over (order by s) n from (select distinct o_orderkey::bigint s from orders where o_orderkey % 5 > 1
      union all select max(o_orderkey)::bigint + 11 from orders where o_orderkey % 5 > 1 union all select -1)) where n > s + 1""",
    "I2_sequence_gaps": "select s + 1 from_sequence, n - 1 to_sequence from (select ledger_sequence s, lead(ledger_sequence) over (order by ledger_sequence) n from led) where n > s + 1",
    "I3_record_gaps": "select id, from_sequence, to_sequence, case when from_sequence % 20 = 0 then 'recorded' else 'retention' end reason from gp group by all",
    "I4_open_gaps": "select id, from_sequence, to_sequence, coalesce(heal_next_to, to_sequence) heal_next_to from gp where not resolved",
    "I5_retention_wall": """select max(ledger_sequence) wall from (select ledger_sequence, lag(ledger_sequence) over (order by ledger_sequence) p from led, top where ledger_sequence >= cursor - 100000)
      where p is null or p < ledger_sequence - 1""",
    "I6_network_reset": "select cast(o_custkey as varchar) network, max(o_orderkey) * 10 as cursor, min(o_orderkey) tip, max(o_orderkey) * 10 > min(o_orderkey) + 17280 as reset from orders group by o_custkey",
    "I7_resume_point": """select cast(c_custkey as varchar) network, case when c_custkey % 3 = 0 then c_custkey * 10 + 1 when c_custkey % 2 = 0 and c_custkey > 0 then c_custkey else c_custkey * 20 end "next",
      case when c_custkey % 3 = 0 then md5(c_name) end expected_hash from customer""",
    "I8_advance_cursor": "select 'testnet' network, cursor ledger_sequence, md5(cast(cursor as varchar)) hash from top",
    "I9_prune_hash_ring": "select ledger_sequence, hash from led, top where ledger_sequence >= cursor - 1000",
    "B1_anchor": "select 'testnet' network, cursor + 20 anchor from top",
    "B2_plan_chunks": """select contract_id, greatest(target_from, c - 1999) chunk_from, c chunk_to from
      (select contract_id, target_from, unnest(range(next_to, target_from - 1, -2000)) c from bf where not done and next_to >= target_from)""",
    "B3_scan_chunk": "select contract_id, count(*) n from stw where ledger_sequence between 8500 and 9800 group by 1",
    "B3_broken_chunks": """select contract_id, f chunk_from, t chunk_to, x ledger_sequence from
      (select contract_id, f, t, min(x) x from (select *, unnest(range(f, t + 1)) x from (select contract_id, greatest(target_from, c - 499) f, c t from
        (select contract_id, target_from, unnest(range(next_to, target_from - 1, -500)) c from bf where not done and next_to >= target_from)))
        left join (select distinct o_orderkey::bigint o from orders where o_orderkey % 611 <> 0) h on h.o = x
        left join (select distinct o_orderkey::bigint o from orders where o_orderkey % 611 <> 0) b on b.o = x - 1
        where h.o is null or (x > f and b.o is not null and x % 1009 = 0) group by 1, 2, 3)""",
    "B3_walk_chunks": """select contract_id, target_from, coalesce(low - 1, next_to) next_to, case when low is null then done else low - 1 < target_from end done, clamped_at, array_to_string(covered, ',') covered_kinds from bf
      left join (select contract_id, min(f) low from (select contract_id, greatest(target_from, c - 499) f from (select contract_id, target_from, unnest(range(next_to, target_from - 1, -500)) c from bf
        where not done and next_to >= target_from)) left join (select contract_id, max(t) stop from (select contract_id, f, t, min(x) x from (select *, unnest(range(f, t + 1)) x from (select contract_id, greatest(target_from, c - 499) f, c t from
        (select contract_id, target_from, unnest(range(next_to, target_from - 1, -500)) c from bf where not done and next_to >= target_from)))
        left join (select distinct o_orderkey::bigint o from orders where o_orderkey % 611 <> 0) h on h.o = x
        left join (select distinct o_orderkey::bigint o from orders where o_orderkey % 611 <> 0) b on b.o = x - 1
        where h.o is null or (x > f and b.o is not null and x % 1009 = 0) group by 1, 2, 3) group by 1) using (contract_id) where stop is null or f > stop group by 1) using (contract_id)""",
    "B4_clamp_at_wall": """select contract_id, target_from, case when hit and 9000 <= next_to then 8999 else next_to end next_to, done or hit done, case when hit then least(9000, next_to + 1) else clamped_at end clamped_at,
      array_to_string(covered, ',') covered_kinds from (select *, not done and target_from < 9000 and next_to >= target_from hit from bf)""",
    "B4_clamp_gaps": """select distinct 'gap:testnet:' || target_from || ':' || least(8999, next_to) id, target_from from_sequence, least(8999, next_to) to_sequence, 'retention' reason
      from bf where not done and target_from < 9000 and next_to >= target_from""",
    "B5_reconcile_backfill": """select contract_id, case when bu is null then rt when ru is null or not (ext or fresh) then bt else least(bt, rt) end target_from,
      case when bu is null or fresh then coalesce(anchor, next_to) else next_to end next_to, case when bu is null then anchor < rt when ext or fresh then false else done end done,
      case when bu is null or ext or fresh then null else clamped_at end clamped_at,
      array_to_string(case when bu is null or ext or fresh then rk when ru is null then covered else [k for k in covered if list_contains(rk, k)] end, ',') covered_kinds
      from (select contract_id, bf.u bu, rq.u ru, bf.target_from bt, rq.target_from rt, anchor, next_to, done, clamped_at, covered, rq.kinds rk, coalesce(rq.target_from < bf.target_from, false) ext,
        coalesce(len([k for k in rq.kinds if not list_contains(bf.covered, k)]) > 0, false) fresh from bf full join rq using (contract_id))""",
    "B6_advance_backfill": """select contract_id, target_from, case when done then next_to else greatest(next_to - 2000, target_from - 1) end next_to, done or greatest(next_to - 2000, target_from - 1) < target_from done, clamped_at,
      array_to_string(covered, ',') covered_kinds from bf""",
    "B7_advance_heal": """select id, case when hit then nn else heal_next_to end heal_next_to, resolved or (hit and nn < from_sequence) resolved from
      (select *, from_sequence % 20 = 0 and not resolved hit, from_sequence + to_sequence % 3 - 1 nn from gp)""",
    "B8_unclamp": """select contract_id, target_from, case when clamped_at is null then next_to when target_from > nn then target_from - 1 else least(nn, next_to) end next_to, done,
      case when target_from > nn then null else clamped_at end clamped_at, array_to_string(covered, ',') covered_kinds from (select *, (clamped_at - 1) // 2 nn from bf)""",
    "B9_upsert_registration": """select contract_id, case when rq.u is not null then 'again' else source end source, array_to_string(coalesce(rq.kinds, reg.kinds), ',') kinds, case when source = 'admin' then 'sac' end classification, registered registered_at
      from reg left join rq using (contract_id) where contract_id not like '%9'""",
    "C1_coverage": """select contract_id, 'state' kind, d derived, case when d then greatest(case when k then next_to + 1 else 15000 end, 2000) else 0 end from_ledger, case when d then 14000 else 0 end::bigint to_ledger,
      d and w and case when k then not done else true end pending, case when d and k then clamped_at end clamped_at from
      (select reg.contract_id, list_contains(reg.kinds, 'state') d, bf.u is not null w, coalesce(list_contains(covered, 'state'), false) k, next_to, done, clamped_at from reg left join bf using (contract_id))""",
    "C1_coverage_without_cursor": """select contract_id, 'events' kind, d derived, case when d then greatest(case when k then next_to + 1 else 0 end, 1) else 0 end from_ledger, 0::bigint to_ledger,
      d and w and case when k then not done else true end pending, case when d and k then clamped_at end clamped_at from
      (select reg.contract_id, list_contains(reg.kinds, 'events') d, bf.u is not null w, coalesce(list_contains(covered, 'events'), false) k, next_to, done, clamped_at from reg left join bf using (contract_id))""",
    "C2_coverage_by_kind": """select contract_id, kind, greatest(case when k then next_to + 1 else 15000 end, 1) from_ledger, 15000::bigint to_ledger, w and case when k then not done else true end pending,
      case when k then clamped_at end clamped_at, place::int place from
      (select reg.contract_id, kind, place, bf.u is not null w, coalesce(list_contains(covered, kind), false) k, next_to, done, clamped_at from reg left join bf using (contract_id)
       join (values ('events', 0), ('state', 1), ('transfers', 2), ('trustlines', 3), ('movements', 4)) v(kind, place) on list_contains(reg.kinds, kind))""",
    "C3_scan_status": """select status, d derived, count(*) n from (select d, case when u % 5 = 0 then 'HAS_MORE' when not d then 'OLDEST_REACHED' when u % 3 = 0 or u % 3 = 2 then 'WAITING_FOR_LEDGERS'
        when 3000 < greatest(case when k then next_to + 1 else 15000 end, 3000) then 'OLDEST_REACHED' else 'COMPLETE' end status from
      (select reg.u, list_contains(reg.kinds, 'events') d, coalesce(list_contains(covered, 'events'), false) k, next_to from reg left join bf using (contract_id))) group by 1, 2""",
    "Q1_feed_equivalence": """select ledger_sequence, min(case change_index % 3 when 0 then '1_header' when 1 then '2_result' else '3_changes' end) first_difference from
      st1 where ledger_sequence % 5 = 0 or (ledger_sequence % 7 = 0 and change_index % 3 = 1) group by 1""",
    "Q1_feed_equivalence_whole": """select ledger_sequence, min(case change_index % 3 when 0 then '1_header' when 1 then '2_result' else '3_changes' end) first_difference from st1
      where starts_with(tx_hash, '00') or (ends_with(tx_hash, '00') and change_index % 3 = 1) group by 1""",
    "Q2_canonicalize_changes": """select l_orderkey, md5(string_agg(unit, ';' order by unit)) canonical from (select l_orderkey, ct, pc, case when ct = 'state' and nc in ('updated', 'removed') then ct || '|' || body || '|' || nc || '|' || nb else ct || '|' || body end unit from
      (select l_orderkey, ct, body, lead(ct) over w nc, lag(ct) over w pc, lead(body) over w nb from (select *, case l_returnflag when 'A' then 'state' when 'N' then 'updated' else 'removed' end ct, cast(l_partkey as varchar) body from lineitem)
       window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice))) where not coalesce(pc = 'state' and ct in ('updated', 'removed'), false) group by 1""",
    "Q3_equivalence_sample": "select distinct o_orderkey ledger_sequence, md5(cast(o_orderkey as varchar)) hash from orders, (select (max(o_orderkey) + 1) // 64 * 64 - 65 cp from orders) where o_orderkey between cp - 7 and cp",
    "R1_events": _vouched(_page("(select * from stored where contract = 'C1')", P["event"], "id"), "C1", "events"),
    "R2_state": _vouched(_page("(select * from stwe where contract_id = 'C1' and not deleted)", 'contract_id, key_xdr, durability, last_ledger, "value"', "key_xdr, durability"), "C1", "state", scan=False),
    "R3_state_history": _vouched(_page("(select * from stw where contract_id = 'C1' and ledger_sequence >= 8000)", "id, key_xdr, change_type, post_value", "id"), "C1", "state", first=8000),
    "R4_transfers": _vouched(_page("(select * from tr where contract_id = 'C3' and transfer_type = 'transfer')", P["transfer"], "id"), "C3", "transfers"),
    "R4_transfers_of_no_one": _vouched(_page("(select * from tr where false)", P["transfer"], "id"), "C4", "transfers", first=9000, last=9500).replace("p.* exclude (has_more)", """p.id, 'C4' contract_id, p.transfer_type, p."from", p."to", p.amount"""),
    "R5_trustlines": _vouched(_page("(select * from tle where contract_id = 'S3' and not deleted)", "account_id, asset, balance, flags", "account_id"), "S3", "trustlines", scan=False),
    "R6_trustline_history": _vouched(_page("(select * from tl1 where contract_id = 'S3' and ledger_sequence <= 9000)", "id, account_id, change_type, post_balance", "id"), "S3", "trustlines", last=9000),
    "R7_movements": _vouched(_page("(select * from mv where contract_id = 'G4')", P["move"], "transfer_id, role"), "G4", "movements"),
    "R8_contracts": "select contract_id, source, array_to_string(kinds, ',') kinds from reg",
    "R9_contract_detail": f"select contract_id, source, (select count(*) from stored where contract = 'C1') events_total, (select count(*) from ste where contract_id = 'C1' and not deleted) state_entries, {COVERED} from reg where contract_id = 'C1'",
    "M1_rate": "select metric, labels, window_start, round(sum(delta) / 300, 6) rate from dl group by 1, 2, 3",
    "M2_quantiles": "select event_type metric, quantile_cont(event_id % 500, 0.5) p50, quantile_cont(event_id % 500, 0.99) p99 from events group by 1",
    "M3_increase": "select metric, labels, window_start, cast(sum(delta) as bigint) increase from dl group by 1, 2, 3",
    "M4_status": """select 'testnet' network, cursor + 1 "next", cursor + 4 tip, open_gaps, pending_walks, 15::bigint lag_seconds, 4::bigint tip_lag, true ready, open_gaps <> 0 as alert
      from top, (select count(*) open_gaps from gp where not resolved), (select count(*) pending_walks from bf where not done)""",
}
BODIES["A6_extraction_audit_whole"] = f"""select ledger_sequence, {', '.join(f'coalesce({c}, 0) {c}' for c in 'failed_txs suppressed_txs suppressed_events suppressed_transfers foreign_undecodable suppressed_trustlines'.split())}
  from ({BODIES['A6_extraction_audit']}) full join (select (o_orderdate::date - date '1970-01-01')::bigint ledger_sequence, count(*) suppressed_trustlines
  from orders join customer on o_custkey = c_custkey where o_orderkey % 19 <> 0 and c_nationkey % 5 = 0 group by 1) using (ledger_sequence)"""
ORACLES = {name: f"with {VIEWS.strip()},\n{SPEC}\n{body}" for name, body in BODIES.items()}
