"""Whole jobs: conversion of a batch, and reconciliation with filed files."""
