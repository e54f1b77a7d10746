"""Fixed values of the metrics; every operator takes them as parameters with these defaults."""

CTL_DAYS = 42.0
ATL_DAYS = 7.0
NP_WINDOW_S = 30
MAX_GAP_S = 3.0
MMP_GRID_S = (1, 5, 15, 30, 60, 120, 300, 600, 1200, 1800, 3600)
CP_LEAST_POINTS = 3
CP_LEAST_RATIO = 3.0
CP_LEAST_R2 = 0.95
CP_DOMAIN_S = (120, 1200)
CP_LEAST_SPREAD = 1e-6
WBAL_TAU = (546.0, -0.01, 316.0)
TRIMP_MALE = (0.64, 1.92)
TRIMP_FEMALE = (0.86, 1.67)
TRIMP_MEAN = (0.75, 1.795)
HRV_MOST_CORRECTED = 0.05
HRV_LEAST_S = 120.0
HRV_ECTOPIC = 0.20
HRV_LF = (0.04, 0.15)
HRV_HF = (0.15, 0.40)
DECOUPLING_LEAST_S = 1200
DECOUPLING_SMOOTH_S = 30
DECOUPLING_LEAST_HALF = 60
DECOUPLING_MOST_CV = 0.5
DURABILITY_TARGET_S = 300
DURABILITY_MULTIPLE = 10.0
INTENSITY_CUTS = (0.55, 0.75, 0.90, 1.05)
INTENSITY_NAMES = ("recovery", "endurance", "tempo", "threshold", "vo2")
READINESS_FORM = (5.0, -10.0, -20.0)
READINESS_NAMES = ("GO", "MAINTAIN", "EASE", "REST")
READINESS_HRV_DROP = 0.10
PROVISIONAL_CONFIDENCE = 0.5
SUBSTITUTED_CONFIDENCE = 0.7
STALE_DAYS = 2
DIAGNOSIS_DAYS = 42
LEAST_FITNESS = 1.0
INSUFFICIENT_DAYS = 14
TIERS = ("raw_stream", "device_computed", "platform_computed", "modeled", "summary_only")
DISPUTE_TOLERANCE = 0.05
#: Fields that sources never dispute, whatever they say.
UNDISPUTED_FIELDS = ("start_time", "sport", "sub_sport", "device_class")
MATCH_START_S = 120
MATCH_DURATION_S = 60
MATCH_DURATION_SHARE = 0.05
MATCH_WINDOW_S = 7200
CLAIM_RELATIVE = 0.02
CLAIM_ABSOLUTE = 0.05
ENDURANCE_WEIGHTS = (0.4, 0.3, 0.3)
ENDURANCE_FULL_CTL = 100.0
ENDURANCE_SHAPE = (0.5, 1.0)
ENDURANCE_FULL_DRIFT = 10.0
POWER_SPORTS = ("cycling",)
PACE_SPORTS = ("running", "walking", "hiking")
SYNC_STALE_DAYS = 3

#: Plausible ranges of a candidate's scalar fields, in the order in which they are checked.
FIELD_RANGES = {
    "avg_power_w": (0.0, 3000.0),
    "max_power_w": (0.0, 4000.0),
    "avg_hr_bpm": (20.0, 260.0),
    "max_hr_bpm": (20.0, 260.0),
    "resting_hr_bpm": (20.0, 200.0),
    "avg_cadence_rpm": (0.0, 300.0),
    "avg_speed_mps": (0.0, 50.0),
    "distance_m": (0.0, 2_000_000.0),
    "elapsed_time_s": (0.0, 604_800.0),
    "moving_time_s": (0.0, 604_800.0),
    "elevation_gain_m": (0.0, 50_000.0),
    "avg_temp_c": (-60.0, 70.0),
    "hrv_rmssd_ms": (0.0, 500.0),
    "hrv_sdnn_ms": (0.0, 500.0),
    "sleep_duration_s": (0.0, 129_600.0),
    "sleep_score": (0.0, 100.0),
    "steps": (0.0, 500_000.0),
    "vo2max": (10.0, 100.0),
}
#: Words before a number that make it a place in a plan, and units that make it a length of time or road.
STRUCTURE_WORDS = ("day", "week", "phase", "block", "zone", "set", "rep", "reps", "round", "interval", "lap")
PLAIN_UNITS = ("m", "min", "mins", "h", "hr", "hrs", "s", "sec", "km", "mi")
#: Words for one kind of activity in English, German and Russian; the first stands for all.
ACTIVITY_WORDS = (
    ("run", "running", "runs", "ran", "laufen", "lauf", "бег", "бегать", "побегать"),
    ("interval", "intervals", "intervalle", "intervall", "интервал", "интервалы"),
    ("sprint", "sprints", "sprinting", "спринт", "спринты"),
    ("jump", "jumps", "jumping", "plyometric", "plyometrics", "springen", "прыжки", "прыжок"),
    ("swim", "swimming", "swims", "schwimmen", "плавание", "плавать"),
    ("ride", "riding", "cycling", "bike", "biking", "radfahren", "велосипед", "езда"),
    ("lift", "lifting", "weights", "deadlift", "deadlifts", "squat", "squats", "heben", "тяга"),
    ("hill", "hills", "climb", "climbs", "climbing", "berg", "berge", "холм", "холмы"),
)
