"""All functions under one roof, by the names that analysts of such recordings use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.columns import epoch_seconds as to_epoch_seconds
from .functions.columns import local_xy, morlet_scale_for_freq, offset_m
from .operators.ais import near_route as filter_near_positions
from .operators.ais import time_window
from .operators.annotate import annotate_files, benchmark_detections, build_annotations, labels_for_range, nearest_ship_distance, ship_positions_at
from .operators.augment import (
    add_noise, channel_dropout, channel_shuffle, frequency_jitter, frequency_shift, gain_randomization, mixup, phase_shift, random_augment,
    spectral_mask, spectral_warp, time_mask, time_warp,
)
from .operators.channels import correlation_matrix, low_correlation_intervals, neighbor_correlation, pair_correlation, sliding_neighbor_correlation
from .operators.detect import cluster_detections, common_mode_suppression, detect_stream, spatial_corroboration, sta_lta_ratio, sta_lta_stream, step_channels
from .operators.evaluate import compute_metrics, evaluate_at_ranges, ground_truth_crossings, match_detections
from .operators.geo import apply_translation, nearest_position, reference_point
from .operators.geo import geojson_linestring as positions_to_geojson_linestring
from .operators.geo import positions_sorted as positions_arrays
from .operators.image import bandpass_energy_image, build_image, crop
from .operators.nearest import Tree
from .operators.offset import closest_approach_offsets as closest_approach_offset
from .operators.offset import estimate_translation as estimate_translation_offset
from .operators.offset import margin_sensitivity
from .operators.quality import channel_quality, measure_noise, persistence_score, select_persistent_channels
from .operators.radon import linear_radon_stack, radon_detect_stream, radon_score
from .operators.select import TargetSelector, context_window, greedy_decorrelated
from .operators.spectral import band_powers, bandpass, bandstop, channel_psd, dominant_frequency, highpass, lowpass, morlet_cwt_power, morlet_cwt_power_series, notch, wavelet_image
from .operators.stats import channel_baseline, channel_stats, describe, temporal_profile
from .operators.transforms import decimate, detrend, normalize, smooth_spatial, smooth_temporal, taper, time_shift
from .sources.files import index_files as index_das_files
from .sources.records import load_annotations, read_reports, save_annotations
from .sources.records import read_cable as load_channel_positions

measure_correlation = correlation_matrix
build_nearest_tree, nearest_index = Tree, nearest_position
#: A stream of one file.
detect_file = detect_stream


def extract_time_window(spark, path: str, start, end, time_format: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """The reports of CSV files in [start, end)."""
    return time_window(read_reports(spark, path, time_format), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def annotate_file(center: Column | str, ais_near: DataFrame, positions: DataFrame, order: str = "ord", time_tol_s: float = 30.0) -> DataFrame:
    """(pos, distance_m) at one time: the distance of each position to the nearest ship, NO_SHIP_SENTINEL_M without."""
    at = F.lit(center) if isinstance(center, str) else center
    one = ais_near.sparkSession.range(1).select(F.col("id").alias("file"), at.cast("timestamp_ntz").alias("center"))
    return nearest_ship_distance(positions, ship_positions_at(one, ais_near, order, time_tol_s))


def nearest_ship_distance_m(positions: DataFrame, ships: DataFrame) -> DataFrame:
    """(pos, distance_m) for one set of ships."""
    return nearest_ship_distance(positions, ships)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "DataFrame", "F")]
