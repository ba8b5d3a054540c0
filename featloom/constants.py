"""Fixed values the results depend on (defaults, cut-offs, labels, texts)."""

# --- fixed values: sizes -----------------------------------------------------
PLOT_SAMPLE_ROWS = 5_000
TRAIN_SAMPLE_ROWS = 20_000
HIGH_CARDINALITY = 50
STRATIFY_MIN_CLASSES = 2
STRATIFY_MAX_CLASSES = 20
TEST_SHARE = 0.2
SEED = 42

# --- fixed values: cut-offs --------------------------------------------------
SIGNAL_HIGH, SIGNAL_MEDIUM = 0.5, 0.2
RANGE_HIGH, RANGE_MEDIUM = 100.0, 10.0
CV_HIGH, CV_MEDIUM = 1.0, 0.3
CV_EPSILON = 1e-10
PAIR_THRESHOLD = 0.8
DOMINANT_SHARE = 0.5
OUTLIER_STDS = 3.0
ABLATION_POINTS = 0.5
SUMMARY_DROP = 0.01
SUMMARY_TOP = 3
SWEEP_POINTS = 20
COMPARE_POINTS = 25
FLAT_RANGE, NOISY_STD = 0.05, 0.1
STRONG_RESPONSE, MODERATE_RESPONSE = 0.2, 0.05
HISTOGRAM_BINS = 30
TOP_VALUES = 20
CHART_HISTOGRAMS, CHART_VS_TARGET, CHART_SEPARATION = 6, 4, 6
BOX_CLASSES, SEPARATION_CLASSES = 10, 5
TOP_CORRELATED, TOP_IMPORTANCE = 3, 3
KNN_NEIGHBOURS = 5

# --- fixed values: option names ----------------------------------------------
LOGISTIC, KNN, SVM, TREE = "Logistic Regression", "KNN", "SVM", "Decision Tree"
MODELS = [LOGISTIC, KNN, SVM, TREE]
SCALE_MODELS = [LOGISTIC, KNN, SVM]
IMPUTATIONS = ["Drop Rows", "Mean", "Median", "Most Frequent", "Constant"]
ENCODINGS = ["Label Encoding", "One-Hot Encoding", "Frequency Encoding"]
SCALINGS = ["No Scaling", "StandardScaler", "MinMaxScaler", "RobustScaler"]

# --- fixed values: texts shown to the user -----------------------------------
MODEL_NOTES = {
    "Logistic Regression": "Sensitive to scale and multicollinearity. Scale features and check VIF.",
    "KNN": "Distance-based; unscaled features dominate. Scaling is critical.",
    "SVM": "Sensitive to scale. Always scale.",
    "Decision Tree": "Scale-invariant but can overfit on noisy features.",
}
NO_MODEL_NOTE = "No specific guidance available."
FLAG_STRONG, FLAG_SCALE, FLAG_TREE, FLAG_DISTANCE, FLAG_NONE = "⭐", "⚖️", "🌳", "📏", "—"
CONTINUOUS_TARGET_ERROR = (
    "The selected target column contains continuous values. "
    "Classification models require discrete class labels."
)
SINGLE_CLASS_ERROR = (
    "Target column must have at least two unique classes. "
    "Cannot train a model on constant or single-class data."
)

# --- fixed values: texts read as missing in CSV cells --------------------------
CSV_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
