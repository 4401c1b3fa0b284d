"""auditlens: code-corpus audit as Spark DataFrame / SQL / streaming plans.

Every operator takes DataFrames and returns DataFrames (see README.md for
the map from operator to module).  Typical flow::

    files = scan_source_tree(spark, "/data/repos")                  # or any files table
    cand = discover_files(files)                                     # exclusions + endpoint rules
    prompts = build_initial_prompts(cand)
    raw = score_prompts(prompts, my_batch_scorer)                    # the one Python hook
    parsed, bad = parse_responses(repair_responses(raw, text_col="raw"))
    findings = responses_to_findings(parsed.withColumnRenamed("path", "file_path"), run_ts=ts)
    write_all_reports(findings, files, out_dir, ts)                  # numbers the findings (with_ordinals)
"""

from auditlens.operators.delivery import (dedupe_issues, issue_rows, notify_discord, notify_json,  # noqa: F401
                                          notify_slack, notify_teams, sign_payloads)
from auditlens.operators.findings import (count_by_confidence, count_by_severity, count_by_vuln_type,  # noqa: F401
                                          filter_min_confidence, filter_min_severity, filter_requested_types,
                                          number_findings, scan_summary, sort_findings, to_findings, top_findings,
                                          with_ordinals)
from auditlens.operators.ledger import (budget_gate, budget_warning, call_costs, cost_by_file, cost_by_model,  # noqa: F401
                                        cost_summary, escalation_stop, estimate_corpus_cost, estimate_file_costs,
                                        file_cost_limit, file_cost_lookup, iteration_cost_limit, remaining_budget,
                                        resolve_pricing, restore_ledger, usage_by_provider)
from auditlens.operators.paths import discover_files, filter_excluded_paths, list_all_files  # noqa: F401
from auditlens.operators.patterns import filter_network_files, pattern_family_hits, sink_rule_scores  # noqa: F401
from auditlens.operators.prompts import (build_initial_prompts, build_readme_prompts, build_secondary_prompts,  # noqa: F401
                                         build_system_prompts, history_window, readme_summaries)
from auditlens.operators.reports import (cost_report, csv_report, fingerprint_findings, html_report,  # noqa: F401
                                         json_report, markdown_report, preview_plan, sarif_report, top_cost_files,
                                         write_all_reports)
from auditlens.operators.responses import parse_responses, repair_responses, responses_to_findings  # noqa: F401
from auditlens.operators.scoring import collect_findings, convergence_stop, score_prompts  # noqa: F401
from auditlens.operators.state import (mark_complete, normalize_state, pending_files, progress_summary,  # noqa: F401
                                       resolve_scan_options, resumable_scans)
from auditlens.operators.symbols import (definition_block, definition_blocks, definition_index, reference_index,  # noqa: F401
                                         resolve_definition, resolve_reference, resolve_symbols_batch)
from auditlens.plans.refine import refine, refine_round  # noqa: F401
from auditlens.sources.files import (explode_lines, file_line_stats, pick_readme, repo_ref_rollup,  # noqa: F401
                                     scan_source_tree, scan_target)
from auditlens.streaming.streams import (read_totals, stream_budget_alerts, stream_cost_totals, stream_incremental_scan,  # noqa: F401
                                         write_totals)
