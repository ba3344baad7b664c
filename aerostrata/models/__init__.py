"""Estimators and their models."""

from aerostrata.models.iforest import IsolationForest, IsolationForestModel
from aerostrata.models.lof import LocalOutlierFactor, LocalOutlierFactorModel
from aerostrata.models.ocsvm import OneClassSvm, OneClassSvmModel
from aerostrata.models.scaler import FeatureScaler, FeatureScalerModel

__all__ = [
    "FeatureScaler", "FeatureScalerModel", "IsolationForest", "IsolationForestModel",
    "LocalOutlierFactor", "LocalOutlierFactorModel", "OneClassSvm", "OneClassSvmModel",
]
