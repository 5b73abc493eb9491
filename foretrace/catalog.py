"""The feature catalog: name, family, entity, window, and whether the value is known before the game."""

from __future__ import annotations

from dataclasses import dataclass

from foretrace.functions.profiles import PROFILES

__all__ = ["FEATURES", "PROFILES", "Feature"]


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    entity: str
    window: str
    point_in_time: bool = True


# The features in their order, as (name, family, entity, window, known before the game).
ROWS = (
    ("hr_rate_season_to_date", "stable", "batter", "to date", True),
    ("batter_k_rate_season_to_date", "stable", "batter", "to date", True),
    ("batter_bb_rate_season_to_date", "stable", "batter", "to date", True),
    ("barrel_rate_last_50_bbe", "stable", "batter", "last 50", True),
    ("hard_hit_rate_last_50_bbe", "stable", "batter", "last 50", True),
    ("avg_launch_angle_last_50_bbe", "stable", "batter", "last 50", True),
    ("avg_exit_velocity_last_50_bbe", "stable", "batter", "last 50", True),
    ("fly_ball_rate_last_50_bbe", "stable", "batter", "last 50", True),
    ("pull_air_rate_last_50_bbe", "stable", "batter", "last 50", True),
    ("recent_form_hr_last_7d", "stable", "batter", "days", True),
    ("recent_form_barrels_last_14d", "stable", "batter", "days", True),
    ("expected_pa_proxy", "stable", "batter", "days", True),
    ("days_since_last_game", "stable", "batter", "days", True),
    ("expected_pa_today", "opportunity", "batter", "days", True),
    ("batting_order_slot", "opportunity", "batter", "days", True),
    ("lineup_confirmation_score", "opportunity", "batter", "days", True),
    ("projected_lineup_rank", "opportunity", "batter", "days", True),
    ("pitcher_hr9_season_to_date", "stable", "pitcher", "to date", True),
    ("pitcher_k_rate_season_to_date", "stable", "pitcher", "to date", True),
    ("pitcher_bb_rate_season_to_date", "stable", "pitcher", "to date", True),
    ("pitcher_barrel_rate_allowed_last_50_bbe", "stable", "pitcher", "last 50", True),
    ("pitcher_hard_hit_rate_allowed_last_50_bbe", "stable", "pitcher", "last 50", True),
    ("pitcher_fb_rate_allowed_last_50_bbe", "stable", "pitcher", "last 50", True),
    ("hr_per_pa_last_30d", "batter_trailing", "batter", "30 days", True),
    ("hr_count_last_30d", "batter_trailing", "batter", "30 days", True),
    ("pa_last_30d", "batter_trailing", "batter", "30 days", True),
    ("barrels_per_pa_last_30d", "batter_trailing", "batter", "30 days", True),
    ("barrels_last_30d", "batter_trailing", "batter", "30 days", True),
    ("hard_hit_rate_last_30d", "batter_trailing", "batter", "30 days", True),
    ("bbe_95plus_ev_rate_last_30d", "batter_trailing", "batter", "30 days", True),
    ("hr_per_pa_last_10d", "batter_trailing", "batter", "10 days", True),
    ("hr_count_last_10d", "batter_trailing", "batter", "10 days", True),
    ("pa_last_10d", "batter_trailing", "batter", "10 days", True),
    ("barrels_per_pa_last_10d", "batter_trailing", "batter", "10 days", True),
    ("barrels_last_10d", "batter_trailing", "batter", "10 days", True),
    ("hard_hit_rate_last_10d", "batter_trailing", "batter", "10 days", True),
    ("bbe_95plus_ev_rate_last_10d", "batter_trailing", "batter", "10 days", True),
    ("avg_exit_velocity_last_10d", "batter_trailing", "batter", "10 days", True),
    ("max_exit_velocity_last_10d", "batter_trailing", "batter", "10 days", True),
    ("pitcher_hr_allowed_per_pa_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_hr_allowed_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_barrels_allowed_per_bbe_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_barrels_allowed_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_hard_hit_allowed_rate_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_hard_hit_allowed_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_bbe_allowed_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_avg_ev_allowed_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_95plus_ev_allowed_rate_last_30d", "pitcher_trailing", "pitcher", "30 days", True),
    ("pitcher_fastball_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_breaking_ball_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_offspeed_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_four_seam_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_sinker_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_cutter_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_slider_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_curveball_pct", "pitch_type", "pitcher", "30 days", True),
    ("pitcher_changeup_pct", "pitch_type", "pitcher", "30 days", True),
    ("batter_hard_hit_rate_vs_fastballs", "pitch_type", "batter", "to date", True),
    ("batter_barrel_rate_vs_fastballs", "pitch_type", "batter", "to date", True),
    ("batter_contact_rate_vs_fastballs", "pitch_type", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_breaking", "pitch_type", "batter", "to date", True),
    ("batter_barrel_rate_vs_breaking", "pitch_type", "batter", "to date", True),
    ("batter_contact_rate_vs_breaking", "pitch_type", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_offspeed", "pitch_type", "batter", "to date", True),
    ("batter_barrel_rate_vs_offspeed", "pitch_type", "batter", "to date", True),
    ("batter_contact_rate_vs_offspeed", "pitch_type", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_slider", "pitch_type", "batter", "to date", True),
    ("batter_barrel_rate_vs_slider", "pitch_type", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_changeup", "pitch_type", "batter", "to date", True),
    ("batter_barrel_rate_vs_changeup", "pitch_type", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_curveball", "pitch_type", "batter", "to date", True),
    ("batter_barrel_rate_vs_curveball", "pitch_type", "batter", "to date", True),
    ("fastball_matchup_hard_hit", "pitch_type", "matchup", "product", True),
    ("fastball_matchup_barrel", "pitch_type", "matchup", "product", True),
    ("breaking_matchup_hard_hit", "pitch_type", "matchup", "product", True),
    ("breaking_matchup_barrel", "pitch_type", "matchup", "product", True),
    ("offspeed_matchup_hard_hit", "pitch_type", "matchup", "product", True),
    ("offspeed_matchup_barrel", "pitch_type", "matchup", "product", True),
    ("slider_matchup_barrel", "pitch_type", "matchup", "product", True),
    ("changeup_matchup_barrel", "pitch_type", "matchup", "product", True),
    ("park_factor_hr", "park", "park", "season", False),
    ("park_factor_hr_vs_lhb", "park", "park", "season", False),
    ("park_factor_hr_vs_rhb", "park", "park", "season", False),
    ("park_factor_hr_vs_batter_hand", "park", "park", "season", False),
    ("batter_hr_per_pa_vs_rhp", "handedness_split", "batter", "to date", True),
    ("batter_hr_per_pa_vs_lhp", "handedness_split", "batter", "to date", True),
    ("batter_hr_per_pa_vs_pitcher_hand", "handedness_split", "batter", "to date", True),
    ("batter_barrels_per_pa_vs_rhp", "handedness_split", "batter", "to date", True),
    ("batter_barrels_per_pa_vs_lhp", "handedness_split", "batter", "to date", True),
    ("batter_barrels_per_pa_vs_pitcher_hand", "handedness_split", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_rhp", "handedness_split", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_lhp", "handedness_split", "batter", "to date", True),
    ("batter_hard_hit_rate_vs_pitcher_hand", "handedness_split", "batter", "to date", True),
    ("batter_95plus_ev_rate_vs_rhp", "handedness_split", "batter", "to date", True),
    ("batter_95plus_ev_rate_vs_lhp", "handedness_split", "batter", "to date", True),
    ("batter_95plus_ev_rate_vs_pitcher_hand", "handedness_split", "batter", "to date", True),
    ("pitcher_hr_allowed_per_pa_vs_rhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_hr_allowed_per_pa_vs_lhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_hr_allowed_per_pa_vs_batter_hand", "handedness_split", "pitcher", "to date", True),
    ("pitcher_barrels_allowed_per_bbe_vs_rhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_barrels_allowed_per_bbe_vs_lhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_barrels_allowed_per_bbe_vs_batter_hand", "handedness_split", "pitcher", "to date", True),
    ("pitcher_hard_hit_allowed_rate_vs_rhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_hard_hit_allowed_rate_vs_lhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_hard_hit_allowed_rate_vs_batter_hand", "handedness_split", "pitcher", "to date", True),
    ("pitcher_95plus_ev_allowed_rate_vs_rhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_95plus_ev_allowed_rate_vs_lhb", "handedness_split", "pitcher", "to date", True),
    ("pitcher_95plus_ev_allowed_rate_vs_batter_hand", "handedness_split", "pitcher", "to date", True),
    ("split_matchup_hr", "handedness_split", "matchup", "product", True),
    ("split_matchup_barrel", "handedness_split", "matchup", "product", True),
    ("split_matchup_hard_hit", "handedness_split", "matchup", "product", True),
    ("starter_or_bullpen_proxy", "context", "matchup", "game", False),
)

FEATURES = {row[0]: Feature(*row) for row in ROWS}
