"""Generated by tools/gen_oracle_doubles.py: DOUBLE output columns per oracle query."""

DOUBLE_COLUMNS = {
    'accuracy': ['accuracy'],
    'amount_bands': ['mean_amount'],
    'amount_to_bank_avg_ratio': ['amount_to_bank_avg_ratio'],
    'asof_group_state': ['route_failure_rate_1m', 'time_since_last_bank_route_success'],
    'assemble': [],
    'attach_bank_route': ['bank_route_success_rate_15m'],
    'attach_baselines': ['route_base_success_rate', 'route_base_latency_ms'],
    'attach_route_features': ['route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_current_load', 'route_requests_1m', 'time_since_last_failure', 'route_flagged_down', 'route_utilization', 'route_effective_capacity_tps', 'system_tps'],
    'attach_sparse_rates': ['bank_failure_rate_5m', 'network_failure_rate_5m', 'route_failure_rate_1m'],
    'average_precision': ['average_precision'],
    'bank_failure_rate_5m': ['bank_failure_rate_5m'],
    'bank_minute': [],
    'bank_route_gap': ['bank_route_gap'],
    'bank_route_success_rate_15m': ['bank_route_success_rate_15m'],
    'best_f1_threshold': ['threshold', 'precision', 'recall', 'f1'],
    'brier': ['brier', 'log_loss', 'accuracy'],
    'calibrate_isotonic_score': ['raw_p', 'p'],
    'calibration_bins': ['mean_predicted_prob', 'actual_success_rate', 'gap'],
    'calibration_gain_score': ['brier_before', 'brier_after'],
    'candidate_feature_lookup': ['amount', 'route_base_success_rate', 'route_base_latency_ms', 'route_cost_percent', 'route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_utilization', 'system_tps', 'time_since_last_failure', 'route_flagged_down', 'bank_route_success_rate_15m', 'route_failure_rate_5m', 'route_failure_rate_15m', 'route_success_drop_5m', 'route_success_drop_15m', 'route_latency_ratio', 'bank_route_gap', 'route_stress', 'bank_failure_rate_5m', 'network_failure_rate_5m', 'route_failure_rate_1m', 'time_since_last_bank_route_success', 'amount_to_bank_avg_ratio'],
    'class_balance': ['failure_ratio', 'base_weight'],
    'class_weights': ['weight'],
    'classification_report': ['precision', 'recall', 'f1_score'],
    'cold_start_fill': ['route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_failure_rate_1m', 'bank_failure_rate_5m', 'network_failure_rate_5m', 'amount_to_bank_avg_ratio', 'route_failure_rate_5m', 'route_failure_rate_15m', 'route_success_drop_5m', 'route_success_drop_15m', 'route_latency_ratio', 'bank_route_gap', 'route_stress'],
    'concat_groups': ['route_success_rate_5m'],
    'confusion_matrix': [],
    'constrained_cost_threshold': ['threshold', 'cost_per_txn', 'failure_recall'],
    'cost_at_threshold': ['threshold', 'total_cost', 'cost_per_txn'],
    'cost_sensitivity': ['mult', 'threshold', 'cost_per_txn', 'failure_precision', 'failure_recall'],
    'cost_sweep': ['threshold', 'total_cost', 'cost_per_txn', 'failure_precision', 'failure_recall', 'failure_f1', 'accuracy'],
    'decision_outcome_join': [],
    'dedup_first': ['amount'],
    'effective_capacity': ['route_effective_capacity_tps'],
    'eligible_by_network': [],
    'eligible_routes': [],
    'eligible_set': [],
    'evaluate': ['value'],
    'expand_candidates': [],
    'feature_projection': ['amount', 'route_base_success_rate', 'route_base_latency_ms', 'route_cost_percent', 'route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_current_load', 'route_requests_1m', 'time_since_last_failure', 'route_flagged_down', 'route_utilization', 'route_effective_capacity_tps', 'system_tps', 'bank_route_success_rate_15m'],
    'feature_slots': [],
    'feature_table': ['amount', 'route_base_success_rate', 'route_base_latency_ms', 'route_cost_percent', 'route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_current_load', 'route_requests_1m', 'time_since_last_failure', 'route_flagged_down', 'route_utilization', 'route_effective_capacity_tps', 'system_tps', 'bank_route_success_rate_15m', 'route_failure_rate_5m', 'route_failure_rate_15m', 'route_success_drop_5m', 'route_success_drop_15m', 'route_latency_ratio', 'bank_route_gap', 'route_stress', 'bank_failure_rate_5m', 'network_failure_rate_5m', 'route_failure_rate_1m', 'time_since_last_bank_route_success', 'amount_to_bank_avg_ratio'],
    'feature_table_minute': ['route_success_rate_5m', 'route_success_rate_15m', 'bank_route_success_rate_15m', 'bank_failure_rate_5m', 'network_failure_rate_5m', 'route_failure_rate_1m', 'time_since_last_bank_route_success', 'amount_to_bank_avg_ratio'],
    'importance_share_difference': ['importance', 'importance_pct'],
    'impute_median': ['median'],
    'impute_mode': [],
    'incident_episodes': [],
    'inf_to_null': ['amount_per_latency'],
    'label_split': [],
    'load_response': ['route_current_load', 'success_rate', 'mean_latency'],
    'log_loss': ['log_loss'],
    'lookup_first_in_tick': ['time_since_last_bank_route_success'],
    'minute_table': ['latency_sum'],
    'model_inputs': ['amount', 'route_base_success_rate', 'route_base_latency_ms', 'route_cost_percent', 'route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_utilization', 'system_tps', 'time_since_last_failure', 'route_flagged_down', 'bank_route_success_rate_15m', 'route_failure_rate_5m', 'route_failure_rate_15m', 'route_success_drop_5m', 'route_success_drop_15m', 'route_latency_ratio', 'bank_route_gap', 'route_stress', 'bank_failure_rate_5m', 'network_failure_rate_5m', 'route_failure_rate_1m', 'time_since_last_bank_route_success', 'amount_to_bank_avg_ratio'],
    'network_failure_rate_5m': ['network_failure_rate_5m'],
    'network_minute': [],
    'no_eligible_route': [],
    'no_eligible_route_orders': [],
    'no_eligible_route_outage': [],
    'null_profile': [],
    'one_hot': [],
    'order_features': [],
    'orders_route_rates': ['route_success_rate_5m', 'route_success_rate_15m'],
    'orders_txn_order_features': ['time_since_last_bank_route_success', 'amount_to_bank_avg_ratio'],
    'orphan_outcomes': [],
    'outcome_proxy': ['outcome_proxy'],
    'overall_baseline': ['overall_baseline'],
    'policy_argmax': ['p'],
    'policy_report': ['success_rate', 'delta_vs_round_robin'],
    'policy_round_robin': [],
    'policy_rows': ['p', 'outcome_proxy'],
    'policy_success_rate': ['success_rate'],
    'pr_curve': ['threshold', 'precision', 'recall'],
    'predict_failure': [],
    'prior_rolling_sum': ['latency_5m'],
    'quarantine_orders': [],
    'ranked_thresholds': ['threshold', 'cost_per_txn', 'total_cost'],
    'read_attempts': ['amount', 'latency_ms'],
    'read_features': [],
    'read_route_metrics': ['latency_sum', 'system_tps', 'route_utilization'],
    'roc_auc': ['roc_auc'],
    'route_avg_latency_5m': ['route_avg_latency_5m'],
    'route_cost': ['route_cost_percent'],
    'route_current_load': ['route_current_load', 'route_requests_1m'],
    'route_failure_rate_1m': ['route_failure_rate_1m'],
    'route_failure_rate_5m': ['route_failure_rate_5m', 'route_failure_rate_15m'],
    'route_flagged_down': ['route_flagged_down'],
    'route_latency_ratio': ['route_latency_ratio'],
    'route_metrics_rollup': ['latency_sum', 'system_tps', 'route_utilization'],
    'route_minute': [],
    'route_stress': ['route_stress'],
    'route_success_drop_5m': ['route_success_drop_5m', 'route_success_drop_15m'],
    'route_success_rate_5m': ['route_success_rate_5m', 'route_success_rate_15m'],
    'spine_fill': [],
    'split_counts': [],
    'stream_bank_amount': ['amount_to_bank_avg_ratio'],
    'stream_bucket_ttl': [],
    'stream_close': [],
    'stream_decision_outcome': [],
    'stream_dedup_outcomes': [],
    'stream_expired_decisions': [],
    'stream_feature_snapshot': ['amount', 'route_base_success_rate', 'route_base_latency_ms', 'route_cost_percent', 'route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_utilization', 'system_tps', 'time_since_last_failure', 'route_flagged_down', 'bank_route_success_rate_15m', 'bank_failure_rate_5m', 'network_failure_rate_5m', 'route_failure_rate_1m', 'time_since_last_bank_route_success', 'amount_to_bank_avg_ratio', 'route_failure_rate_5m', 'route_failure_rate_15m', 'route_success_drop_5m', 'route_success_drop_15m', 'route_latency_ratio', 'bank_route_gap', 'route_stress'],
    'stream_ingress_meter': ['system_tps'],
    'stream_last_flagged': ['route_success_rate_5m', 'route_flagged_down', 'time_since_last_failure'],
    'stream_last_success': [],
    'stream_late_credit': [],
    'stream_minute_buckets': ['latency_sum'],
    'stream_rolling_rates': ['route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_requests_1m'],
    'stream_system_tps': ['system_tps'],
    'target_recall_threshold': ['threshold', 'precision', 'recall'],
    'threshold_metrics': ['threshold', 'failure_precision', 'failure_recall', 'failure_f1', 'accuracy'],
    'time_features': [],
    'time_since_any_failure': ['time_since_any_failure'],
    'time_since_last_bank_route_success': ['time_since_last_bank_route_success'],
    'time_since_last_failure': ['time_since_last_failure'],
    'timeline_bounds': [],
    'top_importance_difference': ['importance', 'importance_pct'],
    'train_validation_cut': [],
    'training_baselines': ['route_base_success_rate', 'route_base_latency_ms'],
    'validate_attempts': [],
    'validate_orders': [],
    'weighted_split': [],
    'write_features': ['amount', 'route_base_success_rate', 'route_base_latency_ms', 'route_cost_percent', 'route_success_rate_5m', 'route_success_rate_15m', 'route_avg_latency_5m', 'route_current_load', 'route_requests_1m', 'time_since_last_failure', 'route_flagged_down', 'route_utilization', 'route_effective_capacity_tps', 'system_tps', 'bank_route_success_rate_15m'],
    'write_importance_difference': ['importance', 'importance_pct'],
}

# integer-valued columns DuckDB widens (HUGEINT) or makes DECIMAL: cast to BIGINT / DOUBLE
WIDE_COLUMNS = {
    'bank_minute': ['failure_count'],
    'class_balance': ['failures', 'successes'],
    'classification_report': ['support'],
    'cost_sweep': ['predicted_failures'],
    'network_minute': ['failure_count'],
    'null_profile': ['n_null'],
    'prior_rolling_sum': ['requests_5m', 'successes_5m', 'requests_15m', 'successes_15m'],
    'route_minute': ['failure_count'],
    'threshold_metrics': ['predicted_failures'],
    'validate_attempts': ['violations'],
    'validate_orders': ['violations'],
}
