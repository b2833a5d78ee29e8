from pyspark.sql import functions as F

from fiberlake import api
from fiberlake.sources.cache import cached

from .test_operators import T0, route

NAMES = """load_channel_positions positions_arrays index_das_files extract_time_window save_annotations load_annotations
positions_to_geojson_linestring crop step_channels context_window local_xy offset_m build_nearest_tree nearest_index
apply_translation filter_near_positions nearest_ship_distance_m annotate_file build_annotations spatial_corroboration
closest_approach_offset estimate_translation_offset margin_sensitivity ground_truth_crossings match_detections build_image
bandpass_energy_image channel_stats temporal_profile persistence_score channel_quality measure_noise
select_persistent_channels channel_baseline neighbor_correlation correlation_matrix measure_correlation pair_correlation
compute_metrics evaluate_at_ranges labels_for_range benchmark_detections sta_lta_ratio common_mode_suppression
smooth_temporal smooth_spatial sliding_neighbor_correlation low_correlation_intervals time_shift bandpass bandstop lowpass
highpass notch channel_psd dominant_frequency band_powers morlet_scale_for_freq morlet_cwt_power morlet_cwt_power_series
wavelet_image detrend taper normalize decimate detect_file detect_stream sta_lta_stream linear_radon_stack radon_score
radon_detect_stream cluster_detections greedy_decorrelated TargetSelector add_noise channel_dropout time_mask spectral_mask
frequency_shift phase_shift spectral_warp mixup channel_shuffle gain_randomization time_warp frequency_jitter random_augment
to_epoch_seconds""".split()


def test_every_name_is_there():
    assert [n for n in NAMES if not callable(getattr(api, n, None))] == []


def test_annotate_file(spark):
    cable = route(spark, 10)
    p = cable.filter("pos = 3").first()
    ais = spark.createDataFrame([(0, 1, T0, p.lat, p.lon)], "ord int, MMSI long, Timestamp timestamp_ntz, Latitude double, Longitude double")
    near = {r.pos: r.distance_m for r in api.annotate_file("2025-01-01 00:00:10", ais, cable).collect()}
    assert near[3] == 0 and abs(near[4] - 2) < 1e-3 and len(near) == 10
    assert [(r.pos, r.distance_m) for r in api.annotate_file("2025-01-01 00:01:10", ais, cable).orderBy("pos").collect()] == [(i, 999999.0) for i in range(10)]


def test_cache_follows_its_files(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    files = spark.createDataFrame([("a", 1), ("b", 2)], "file string, size long")
    for tag, index, calls in (("x", files, 1), ("x", files, 1), ("y", files, 2), ("y", files.withColumn("size", F.col("size") + 1), 3)):
        assert cached(spark, str(tmp_path / "c"), tag, index, make).count() == 3 and len(made) == calls
