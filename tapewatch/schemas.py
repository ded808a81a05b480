"""Column schemas of all tables, as DDL."""

TRADE = "exchange string, symbol string, timestamp_ms long, price double, quantity double, taker_side string, event_id string, received_wall_ms long, received_monotonic_s double, continuity_generation long, arrival_seq long"
LIQUIDATION = TRADE.replace("taker_side", "liquidated_side")
BUCKET = "exchange string, symbol string, start_ms long, open double, high double, low double, close double, quote_volume double, buy_quote_volume double, sell_quote_volume double, trades long, first_trade_ms long, last_trade_ms long"
BREAK = "exchange string, symbol string, start_ms long, end_ms long, reason string"
CONTINUITY_EVENT = "exchange string, phase string, timestamp_ms long, reason string, symbol string"
METRIC = "timestamp_ms long, exchange string, symbol string, window_seconds int, ready boolean, price double, return_bps double, return_z double, quote_volume double, volume_z double, taker_imbalance double, trades long, baseline_points int, data_age_seconds double, readiness_reason string, window_coverage_ratio double, largest_gap_seconds double, recovery_seconds_remaining double"
ALERT = "id string, timestamp_ms long, severity string, category string, symbol string, direction string, title string, message string, exchanges array<string>, metrics_json string, dedup_key string, source string"
RECEIPT = "id long, alert_id string, timestamp_ms long, channel string, status string, attempt int, detail string"
JOB = "alert_id string, priority int, original_dedup_key string, status string, attempt int, updated_ms long"
FRAME = "frame string, received_wall_ms long, received_monotonic_s double, continuity_generation long, arrival_seq long"
EVIDENCE_TEXT = "line string"
