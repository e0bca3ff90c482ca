"""Declared schemas of the feeds (DDL strings). Times in milliseconds are BIGINT."""

#: The feeds' columns.
TRANSACTIONS = "transaction_id STRING, account_id STRING, customer_id STRING, amount DECIMAL(18,2), currency STRING, direction STRING, counterparty_iban STRING, counterparty_name STRING, merchant_category STRING, country_code STRING, channel STRING, tx_timestamp BIGINT"
CUSTOMERS = "customer_id STRING, full_name STRING, date_of_birth DATE, residency_country STRING, risk_segment STRING, pep_flag BOOLEAN, kyc_status STRING, created_at BIGINT, updated_at BIGINT"
KYC_RESULTS = "event_id STRING, customer_id STRING, provider STRING, check_type STRING, status STRING, risk_level STRING, reasons STRING, completed_at BIGINT"
SANCTIONS = "match_id STRING, customer_id STRING, list_type STRING, entity_id STRING, matched_name STRING, match_score DOUBLE, status STRING, reviewed_by STRING, reviewed_at BIGINT"
LEDGER_UPDATES = "event_id STRING, customer_id STRING, account_id STRING, available_balance DOUBLE, current_balance DOUBLE, ledger_balance DOUBLE, currency STRING, updated_at BIGINT"
AUTH_EVENTS = "event_id STRING, customer_id STRING, account_id STRING, auth_id STRING, merchant STRING, amount DOUBLE, currency STRING, status STRING, expected_settlement_at BIGINT, created_at BIGINT"
TRANSFERS = "event_id STRING, customer_id STRING, account_id STRING, transfer_id STRING, type STRING, amount DOUBLE, currency STRING, status STRING, failure_reason STRING, expected_eta BIGINT, tracking_ref STRING, initiated_at BIGINT, updated_at BIGINT"
HOLDS = "event_id STRING, customer_id STRING, account_id STRING, hold_id STRING, reason_code STRING, status STRING, release_conditions STRING, velocity_limit_per_hour INT, created_at BIGINT, updated_at BIGINT"
DISPUTES = "event_id STRING, customer_id STRING, account_id STRING, dispute_id STRING, related_auth_id STRING, stage STRING, provisional_credit_status STRING, next_required_action STRING, created_at BIGINT, updated_at BIGINT"
NOTIFICATIONS = "event_id STRING, customer_id STRING, channel STRING, message_type STRING, message STRING, sent_at BIGINT"
USER_INTERACTIONS = "event_type STRING, user_id STRING, event_ts_long BIGINT, content_id STRING, search_query STRING, duration_ms INT"
CONTENT_METADATA = "ts_long BIGINT, content_id STRING, title STRING, genres STRING"
LOGINS = "event_timestamp BIGINT, user_id STRING, src_ip STRING, location STRING, device_id STRING, outcome STRING, mfa_used BOOLEAN"
NETWORK_FLOWS = "event_timestamp BIGINT, src_ip STRING, dest_ip STRING, dest_port INT, protocol STRING, bytes_sent BIGINT"
IDS_ALERTS = "event_timestamp BIGINT, src_ip STRING, signature STRING, severity STRING"
FLIGHTS = "flight_id STRING, flight_status STRING, origin STRING, destination STRING, scheduled_departure TIMESTAMP, event_timestamp TIMESTAMP"
BOOKINGS = "booking_id STRING, flight_id STRING, passenger_id STRING, seat STRING, booking_timestamp TIMESTAMP"
PROFILES = "passenger_id STRING, first_name STRING, last_name STRING, loyalty_tier STRING, preferences STRUCT<seating: STRING>, update_timestamp TIMESTAMP"
SIGN_INS = "event_timestamp BIGINT, user_email STRING, event_type STRING, outcome STRING, ip_address STRING, country STRING, is_suspicious BOOLEAN"
DOWNLOADS = "event_timestamp BIGINT, `user` STRING, `action` STRING, url STRING, file_name STRING, file_size_bytes INT"
DETECTIONS = "event_timestamp BIGINT, user_email STRING, detection_name STRING, severity STRING, file_hash_sha256 STRING, file_name STRING, action_taken STRING"
ONCHAIN = "tx_hash STRING, block_number BIGINT, event_timestamp BIGINT, from_address STRING, to_address STRING, tx_token STRING, tx_amount DOUBLE"
DEX_PRICES = "event_timestamp BIGINT, token_pair STRING, price DOUBLE, join_helper STRING"
MEMPOOL = "event_timestamp BIGINT, block_number BIGINT, avg_gas_price_gwei INT"
VITALS = "patient_id STRING, event_timestamp TIMESTAMP, heart_rate_bpm INT, respiratory_rate_rpm INT, skin_temp_c DECIMAL(5,2), activity_level STRING"
PLAYER_ACTIONS = "match_id STRING, player_id STRING, event_timestamp BIGINT, action_type STRING, weapon STRING, target_id STRING, is_headshot BOOLEAN, reaction_time_ms INT, seq BIGINT"
PLAYER_HISTORY = "player_id STRING, update_timestamp BIGINT, total_matches_played INT, historical_headshot_rate DOUBLE, historical_accuracy DOUBLE"
AUDIT_RAW = (
    "dataschema STRING, id STRING, specversion STRING, time STRING, type STRING, source STRING, "
    "oracle STRUCT<compartmentid: STRING, ingestedtime: STRING, loggroupid: STRING, tenantid: STRING>, "
    "data STRUCT<additionalDetails: STRING, availabilityDomain: STRING, compartmentId: STRING, compartmentName: STRING, definedTags: STRING, eventGroupingId: STRING, eventName: STRING, freeformTags: STRING, "
    "identity: STRUCT<authType: STRING, callerId: STRING, callerName: STRING, consoleSessionId: STRING, credentials: STRING, ipAddress: STRING, principalId: STRING, principalName: STRING, tenantId: STRING, userAgent: STRING>, "
    "message: STRING, request: STRUCT<action: STRING, headers: STRUCT<`User-Agent`: ARRAY<STRING>, `X-Forwarded-For`: ARRAY<STRING>, `opc-request-id`: ARRAY<STRING>>, id: STRING, parameters: STRING, path: STRING>, "
    "resourceId: STRING, response: STRUCT<headers: STRING, message: STRING, payload: STRING, responseTime: STRING, status: STRING>, "
    "stateChange: STRUCT<current: STRUCT<responseObject: STRING>, previous: STRUCT<requestObject: STRING>>>"
)
FUNCTION_LOG_RAW = (
    "id STRING, time STRING, type STRING, source STRING, subject STRING, specversion STRING, "
    "oracle STRUCT<compartmentid: STRING, tenantid: STRING, ingestedtime: STRING, loggroupid: STRING, logid: STRING>, "
    "data STRUCT<applicationId: STRING, functionId: STRING, containerId: STRING, message: STRING, opcRequestId: STRING, requestId: STRING, src: STRING>"
)
PAGE_VIEWS = "event_timestamp TIMESTAMP, user_id STRING, page STRING"
CART_UPDATES = "event_timestamp TIMESTAMP, user_id STRING, cart_action STRING, item_id STRING"
CHATS = "event_timestamp TIMESTAMP, user_id STRING, message STRING"
