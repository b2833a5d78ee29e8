"""Schemas of the data model, as DDL, and constants.

image      one value for each time bin t and channel (0-based position along the fibre)
waveform   one row for each file and channel, with the channel's samples
positions  one row for each point of the cable; pos is its 0-based place in the order of channel_id
"""

IMAGE = "t long, channel int, value double"
WAVEFORM = "file string, file_ts timestamp_ntz, channel int, samples array<double>"
POSITIONS = "channel_id int, pos int, lat double, lon double, depth double"
AIS = "Timestamp timestamp_ntz, `Type of mobile` string, MMSI long, Latitude double, Longitude double, SOG double, Name string"
DETECTIONS = "time_s double, channel int, score double, triggered boolean, timestamp timestamp_ntz, file string"
EVENTS = "timestamp timestamp_ntz, channel int, score double, n_members long"
ANNOTATIONS = "file string, center_time timestamp_ntz, channel int, distance_m double"

# Fixed values
METERS_PER_DEGREE_LAT = 111320.0
EDGE_TRIM_S = 1.0
DEFAULT_BANDPASS_HZ = (1.0, 20.0)
MORLET_W0 = 6.0
VESSEL_CLASSES = ("Class A", "Class B")
NO_SHIP_SENTINEL_M = 999999.0
MAD_SCALE = 1.4826
