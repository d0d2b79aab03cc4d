"""Schemas of the landing and derived tables. Nothing is inferred."""

from __future__ import annotations

TAGGED = "struct<t:string,v:string,b64:string>"
PAIR = "struct<key:struct<t:string,v:string>,val:struct<t:string,v:string>>"
VALUE = f"struct<t:string,v:string,map:array<{PAIR}>,b64:string>"

LEDGERS = "network string, ledger_sequence bigint, hash string, previous_hash string, closed_at timestamp"
TRANSACTIONS = "network string, ledger_sequence bigint, closed_at timestamp, tx_index int, tx_hash string, successful boolean, readable boolean"
RAW_EVENTS = (
    "network string, ledger_sequence bigint, closed_at timestamp, tx_index int, tx_hash string, op_index int, pos_in_op int, event_type string, "
    f"contract_id string, body_version int, topics array<{TAGGED}>, value {VALUE}, raw_b64 string"
)
SIDE = "struct<contract_id:string,key_b64:string,value_b64:string,durability:string,account_id:string,asset:string,asset_type:string,balance:bigint,limit:bigint,flags:bigint>"
RAW_CHANGES = (
    "network string, ledger_sequence bigint, closed_at timestamp, tx_index int, tx_hash string, op_index int, pos_in_tx int, entry_type string, "
    f"change_type string, pre {SIDE}, post {SIDE}"
)
REGISTRATIONS = "network string, contract_id string, source string, kinds array<string>, registered_at timestamp"
BACKFILL = "network string, contract_id string, target_from bigint, next_to bigint, done boolean, clamped_at bigint, covered_kinds array<string>"
GAPS = "id string, network string, from_sequence bigint, to_sequence bigint, reason string, recorded_at timestamp, resolved_at timestamp, heal_next_to bigint"

ASSETS = "network string, asset string, contract_id string"
#: Tables of a landing folder that have ledgers.
LANDING = {"ledgers": LEDGERS, "transactions": TRANSACTIONS, "raw_events": RAW_EVENTS, "raw_changes": RAW_CHANGES}

EVENTS = (
    "network string, id string, contract_id string, ledger_sequence bigint, closed_at timestamp, tx_hash string, tx_index int, op_index int, event_index int, "
    "event_name string, topic0 string, topic1 string, topic2 string, topic3 string, topics_b64 array<string>, value_b64 string, raw_b64 string"
)
TRANSFERS = (
    "network string, id string, contract_id string, ledger_sequence bigint, closed_at timestamp, tx_hash string, event_index int, transfer_type string, "
    "`from` string, `to` string, amount string, asset string, to_muxed_id string"
)
MOVEMENTS = (
    "network string, contract_id string, transfer_id string, role string, token_contract_id string, ledger_sequence bigint, transfer_type string, "
    "counterparty string, amount string, asset string"
)
STATE_CHANGES = (
    "network string, id string, contract_id string, ledger_sequence bigint, closed_at timestamp, tx_hash string, tx_index int, change_index int, change_type string, "
    "key_xdr string, durability string, pre_value string, post_value string"
)
TRUSTLINE_CHANGES = (
    "network string, id string, contract_id string, account_id string, asset string, ledger_sequence bigint, closed_at timestamp, tx_hash string, tx_index int, "
    "change_index int, change_type string, pre_balance bigint, post_balance bigint, post_limit bigint, flags bigint"
)
HASHES = "network string, ledger_sequence bigint, hash string"
#: Ledgers that have been derived, with a digest of all that had landed of them.
DERIVED = "network string, ledger_sequence bigint, digest string"
#: The last ledger of each network and the first that was derived live.
CURSORS = "network string, ledger_sequence bigint, hash string, base bigint"

KINDS = ("events", "state", "transfers", "trustlines", "movements")
MOVEMENT_NAMES = ("transfer", "mint", "burn", "clawback")
#: The protocol's events of a built-in asset contract.
BUILT_IN_EVENTS = ("approve", "burn", "clawback", "mint", "set_admin", "set_authorized", "transfer")
