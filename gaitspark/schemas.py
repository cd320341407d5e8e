"""Keys and schemas of the tables. Ids are strings; times are seconds as doubles; missing is NULL, never NaN."""

from __future__ import annotations

TRIAL = ["participant_id", "session_id", "trial_id"]
TRIAL_KEYS = [*TRIAL, "condition"]

#: Modalities and the manifest's columns.
MODALITIES = ("imu", "video", "audio", "footswitch", "annotation", "clinical")
MANIFEST = [*TRIAL[:2], "condition", "trial_id", *[f"{m}_path" for m in MODALITIES]]

#: Canonical signals of the inertial sensor.
ACCELERATION = ("acc_ap", "acc_ml", "acc_vertical")
ANGULAR = ("gyro_x", "gyro_y", "gyro_z", "gyro_yaw")
QUATERNION = ("quat_w", "quat_x", "quat_y", "quat_z")
SIGNALS = (*ACCELERATION, *ANGULAR, *QUATERNION)

#: Phases whose samples count as straight walking.
WALKING = ("outbound_walk", "return_walk", "combined_straight_walk")

_ids = ", ".join(f"{k} string" for k in TRIAL_KEYS)
LANDMARKS = f"{_ids}, frame_index long, timestamp double, landmark_name string, x double, y double, visibility double"
FRAMES = f"{_ids}, frame_index long, timestamp double, pose_detected boolean"
