"""Feature transformers: fit learns from one frame, transform is a projection of another."""

from .creators import BinDiscretizer, InteractionFeatures, PolynomialFeatures
from .encoders import FrequencyEncoder, LabelEncoder, OneHotEncoder, OrdinalEncoder, TargetEncoder
from .imputers import IterativeImputer, KNNImputer, SimpleImputer
from .pipeline import Pipeline, load_pipeline
from .scalers import MaxAbsScaler, MinMaxScaler, RobustScaler, StandardScaler
from .selectors import RFE, SelectKBest, SelectPercentile, VarianceThreshold

__all__ = [
    "RFE", "BinDiscretizer", "FrequencyEncoder", "InteractionFeatures", "IterativeImputer", "KNNImputer", "LabelEncoder", "MaxAbsScaler", "MinMaxScaler",
    "OneHotEncoder", "OrdinalEncoder", "Pipeline", "PolynomialFeatures", "RobustScaler", "SelectKBest", "SelectPercentile", "SimpleImputer", "StandardScaler",
    "TargetEncoder", "VarianceThreshold", "load_pipeline",
]
