"""Operators on voxel tables, point tables, trees and graphs."""
