"""Models, splitting, cross-validation and metrics."""

from .cluster import KMeans
from .decomposition import PCA
from .linear import Lasso, LinearRegression, LogisticRegression, Ridge
from .tree import DecisionTreeClassifier, DecisionTreeRegressor

__all__ = ["PCA", "DecisionTreeClassifier", "DecisionTreeRegressor", "KMeans", "Lasso", "LinearRegression", "LogisticRegression", "Ridge"]
