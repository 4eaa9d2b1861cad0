"""Whole plans: pricing, price card, sizing, requests, validation, calibration, reconciliation."""
