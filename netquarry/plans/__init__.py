"""Ready-made audits, reports, KPI queries and flattening."""

from netquarry.plans.area_audits import audit_multi_tac, audit_tac_lac
from netquarry.plans.flatten import (
    flatten_items,
    flatten_lists,
    flatten_parameters,
    publish_daily,
)
from netquarry.plans.kpi import kpi_frame, kpi_pivot, kpi_query, split_kpis_by_scale
from netquarry.plans.neighbour_audits import (
    audit_code_conflicts,
    audit_missing_relations,
    handover_share,
    lte_cells,
    site_adjacency,
)
from netquarry.plans.radio_audits import (
    antenna_tilts,
    audit_rssi,
    audit_rtwp,
    audit_tilt_same_sector,
    audit_tilt_vs_baseline,
    kpi_history,
)
from netquarry.plans.reports import (
    probe_kpis,
    report_gsm_cell,
    report_lte_cell,
    report_lte_site,
    report_umts_cell,
    report_umts_site,
    run_reports,
)
from netquarry.plans.selection import select_cells, site_directory
from netquarry.plans.site_audits import audit_parameters, audit_sw_version, site_list
from netquarry.plans.views import SiteViews

__all__ = [
    "SiteViews",
    "antenna_tilts",
    "audit_code_conflicts",
    "audit_missing_relations",
    "audit_multi_tac",
    "audit_parameters",
    "audit_rssi",
    "audit_rtwp",
    "audit_sw_version",
    "audit_tac_lac",
    "audit_tilt_same_sector",
    "audit_tilt_vs_baseline",
    "flatten_items",
    "flatten_lists",
    "flatten_parameters",
    "handover_share",
    "kpi_frame",
    "kpi_history",
    "kpi_pivot",
    "kpi_query",
    "lte_cells",
    "probe_kpis",
    "publish_daily",
    "report_gsm_cell",
    "report_lte_cell",
    "report_lte_site",
    "report_umts_cell",
    "report_umts_site",
    "run_reports",
    "select_cells",
    "site_adjacency",
    "site_directory",
    "site_list",
    "split_kpis_by_scale",
]
