"""Every query outside the training-data operators, by name."""

from __future__ import annotations

from cinderframe.plans import analysis_queries, audit_queries, detail_queries, frame_queries, fleet_queries, fuel_queries, observation_queries, profile_queries, raster_queries, service_queries, source_queries, stream_queries, study_queries, time_queries

_PLANS = (time_queries, study_queries, raster_queries, audit_queries, stream_queries, profile_queries, observation_queries, fleet_queries, fuel_queries, source_queries, analysis_queries, frame_queries, detail_queries, service_queries)
FLAGSHIP = "q_asof_interp"
QUERIES = {name: f for m in _PLANS for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _PLANS for name, sql in m.SQL.items()}
